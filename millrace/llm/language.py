"""Language identification by unigram pieces, summed over all segmentations.

A language is a distribution over the pieces of a fixed public vocabulary. A word's probability is the sum, over every way to
cut it into pieces, of the product of their probabilities; the forward algorithm computes it. A text is its words, and the
language with the highest posterior is its prediction. The distributions are learned by expectation maximisation on the
same sum (forward and backward) over all words of a bounded sample of labelled documents; workers count, the driver only adds.

Words repeat, so a worker keeps the scores of words it has seen, up to a fixed number of words and of scores, and sums them per text. The next
training, or another operator that begins on the worker, drops them.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import held_out, seeded, table, worker_store, written

START = "▁"  # marks a word's start in the vocabulary
UNDETERMINED = "und"
_WORD = re.compile(r"[^\W\d_]+")
_LONG = 48  # letters up to which no sum leaves the range of doubles, with _SCALE for each letter
_FLOOR = 1e-12
_SCALE = 1e6
_CELLS = 1 << 23  # scores that a worker keeps, 64 MB, however many languages there are
_AT_ONCE = 4000  # words of a lattice; fewer from 16 languages on
_UNIT = 1 << 32  # expected counts are added as whole multiples of 1 / _UNIT, so that their order doesn't matter


def read_pieces(path: str | None = None) -> list[str]:
    """The pieces of a sentencepiece vocabulary, without control and byte pieces. path: by default the public one of 32k pieces."""
    import sentencepiece

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=str(path))
    ids = range(model.get_piece_size())
    return [model.id_to_piece(i) for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]


def words_of(text: str | None) -> list[str]:
    """Lower-case runs of letters; none if the text has no letter."""
    found = _WORD.findall(text.lower()) if text else []
    return found if any(c.isalpha() for w in found for c in w) else []


_SALT = np.uint64(0xD6E8FEB86659FD93)
_BASE = 0x9E3779B97F4A7C15
_TABLE_BITS = 18


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


class Vocabulary:
    """Pieces by a 64-bit hash of their code points, so that all substrings of many words are looked up at once."""

    def __init__(self, pieces: list[str]) -> None:
        self.size, self.longest = len(pieces), max(map(len, pieces), default=1)
        codes, ends = self._codes(pieces)
        total, _, down = self._sums(codes)
        first = np.r_[0, ends[:-1]].astype(np.int64)
        keys = (total[ends] - total[first]) * down[first] + (ends - first).astype(np.uint64) * _SALT
        self.keys, self.piece = np.zeros(1 << _TABLE_BITS, np.uint64), np.full(1 << _TABLE_BITS, -1)
        self.more: dict[int, int] = {}  # pieces whose place in the table is taken
        for i, k in enumerate(keys.tolist()):
            at = self._at(np.uint64(k))
            if self.piece[at] < 0:
                self.keys[at], self.piece[at] = k, i
            else:
                self.more[k] = i
        self.rest = np.array(sorted(self.more), np.uint64)
        self.rest_piece = np.array([self.more[k] for k in self.rest.tolist()], np.int64)

    @staticmethod
    def _at(key: np.ndarray) -> np.ndarray:
        return (key ^ (key >> np.uint64(31))) >> np.uint64(64 - _TABLE_BITS)

    @staticmethod
    def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        return codes, np.cumsum([len(w) for w in words], dtype=np.int64)

    @staticmethod
    def _sums(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        up, down = _powers(len(codes) + 1)
        total = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum((codes + np.uint64(1)) * up[:-1], out=total[1:])
        return total, up, down

    def edges(self, words: list[str]) -> tuple[np.ndarray, ...]:
        """(word, start, end, piece) of all pieces in the words, each with a start mark; an unknown letter is piece ``size``."""
        codes, ends = self._codes([START + w for w in words])
        total, _, down = self._sums(codes)
        lengths = np.diff(np.r_[0, ends])
        word = np.repeat(np.arange(len(words)), lengths)
        start = np.arange(len(codes)) - (ends - lengths)[word]
        left = lengths[word] - start
        at = np.arange(len(codes))
        out = []
        for n in range(1, self.longest + 1):
            at = at[left[at] >= n]
            if not len(at):
                break
            key = (total[at + n] - total[at]) * down[at] + np.uint64(n * int(_SALT) % (1 << 64))
            cell = self._at(key)
            piece = np.where(self.keys[cell] == key, self.piece[cell], -1)
            if len(self.rest):
                k = np.minimum(np.searchsorted(self.rest, key), len(self.rest) - 1)
                piece = np.where((piece < 0) & (self.rest[k] == key), self.rest_piece[k], piece)
            if n == 1:
                piece = np.where(piece < 0, self.size, piece)
            hit = piece >= 0
            out.append(tuple(x.astype(np.int32) for x in (word[at[hit]], start[at[hit]], start[at[hit]] + n, piece[hit])))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


class Lattice:
    """The edges of all segmentations of some words. A letter outside the vocabulary is an edge of its own, unknown to all languages alike."""

    def __init__(self, words: list[str], vocabulary: Vocabulary) -> None:
        self.lengths = np.array([len(w) + 1 for w in words])
        self.word, self.start, self.end, self.piece = vocabulary.edges(words)
        self.scale = _SCALE ** np.arange(vocabulary.longest + 1.0)[self.end - self.start, None]

    def _levels(self, by: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        order = np.argsort(by.astype(np.int64) * len(self.lengths) + self.word, kind="stable")
        cuts = np.searchsorted(by[order], np.arange(by.max(initial=0) + 2))
        for level in range(len(cuts) - 1):
            if cuts[level] < cuts[level + 1]:
                yield level, order[cuts[level] : cuts[level + 1]]

    def forward(self, p: np.ndarray) -> np.ndarray:
        """alpha[word, position, language] times _SCALE for each letter up to the position; p: piece by language, with the unknown letter last."""
        alpha = np.zeros((len(self.lengths), self.lengths.max() + 1, p.shape[1]))
        alpha[:, 0] = 1
        for level, at in self._levels(self.end):
            w = self.word[at]
            first = np.flatnonzero(np.r_[True, w[1:] != w[:-1]])
            alpha[w[first], level] = np.add.reduceat(alpha[w, self.start[at]] * (p[self.piece[at]] * self.scale[at]), first)
        return alpha

    def backward(self, p: np.ndarray) -> np.ndarray:
        beta = np.zeros((len(self.lengths), self.lengths.max() + 1, p.shape[1]))
        beta[np.arange(len(self.lengths)), self.lengths] = 1
        for level, at in reversed([*self._levels(self.start)]):
            w = self.word[at]
            first = np.flatnonzero(np.r_[True, w[1:] != w[:-1]])
            beta[w[first], level] += np.add.reduceat(beta[w, self.end[at]] * (p[self.piece[at]] * self.scale[at]), first)
        return beta


@dataclass
class LanguageModel:
    pieces: list[str]
    languages: list[str]
    p: np.ndarray  # piece by language; the last row is the unknown letter
    log_prior: np.ndarray
    cache_words: int = 400_000
    token: str = field(default_factory=lambda: uuid.uuid4().hex)  # tells the models of a worker apart
    vocabulary: Vocabulary | None = None

    def __post_init__(self) -> None:
        self.vocabulary = self.vocabulary or Vocabulary(self.pieces)
        self.place = {x: i for i, x in enumerate(self.pieces)}

    def score_words(self, words: list[str]) -> np.ndarray:
        """log P(word | language), word by language."""
        out = np.empty((len(words), len(self.languages)))
        short, step = [k for k, w in enumerate(words) if len(w) <= _LONG], max(1, _AT_ONCE * 16 // max(16, len(self.languages)))
        for i in range(0, len(short), step):
            part = short[i : i + step]
            lattice = Lattice([words[k] for k in part], self.vocabulary)
            out[part] = np.log(lattice.forward(self.p)[np.arange(len(part)), lattice.lengths]) - lattice.lengths[:, None] * np.log(_SCALE)
        for k, w in enumerate(words):
            if len(w) > _LONG:
                out[k] = self._long(w)
        return out

    def _long(self, word: str) -> np.ndarray:
        """The same sum with every position rescaled, for words of any length; it holds only as many positions as a piece has letters."""
        s, unknown = START + word, len(self.place)
        recent: list[np.ndarray] = [np.zeros(len(self.languages))]  # log alpha of the last positions
        for j in range(1, len(s) + 1):
            terms = []
            for i in range(max(0, j - self.vocabulary.longest), j):
                q = self.place.get(s[i:j], unknown if j - i == 1 else None)
                if q is not None:
                    terms.append(recent[i - j] + np.log(self.p[q]))
            recent = [*recent, np.logaddexp.reduce(terms)][-self.vocabulary.longest :]
        return recent[-1]

    def identify(self, texts: list[str | None]) -> list[tuple[str, float]]:
        store, room = worker_store(self.token), max(2, min(self.cache_words, _CELLS // max(1, len(self.languages))))
        if "seen" not in store:
            store.update(seen={}, scores=np.empty((room, len(self.languages))))
        seen, scores = store["seen"], store["scores"]
        split = [words_of(t) if self.languages else [] for t in texts]
        out: list[tuple[str, float]] = []
        totals = [self.log_prior.copy() for _ in texts]
        # Words of a few texts at a time, or a part of one long text: as many as the store can surely hold.
        most, parts, held = room // 2, [], 0
        todo = [(k, words[i : i + most]) for k, words in enumerate(split) for i in range(0, len(words), most)]
        for n, (k, part) in enumerate(todo):
            parts.append((k, part))
            held += len(part)
            if n + 1 < len(todo) and held + len(todo[n + 1][1]) <= most:
                continue
            every = set().union(*(p for _, p in parts))
            new = every.difference(seen)
            if len(seen) + len(new) > room:
                seen.clear()
                new = every
            if new:
                words = sorted(new)
                scores[len(seen) : len(seen) + len(words)] = self.score_words(words)
                seen.update(zip(words, range(len(seen), len(seen) + len(words)), strict=True))
            for j, p in parts:
                totals[j] += scores[list(map(seen.__getitem__, p))].sum(axis=0)
            parts, held = [], 0
        for words, total in zip(split, totals, strict=True):
            if not words:
                out.append((UNDETERMINED, 0.0))
                continue
            best = int(np.argmax(total))
            out.append((self.languages[best], float(1 / np.exp(total - total[best]).sum())))
        return out


def _long_expected(word: str, p: np.ndarray, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(piece, expected count) of one word of any length under one language's p, in logarithms."""
    _, start, end, piece = vocabulary.edges([word])
    log_p, size = np.log(p)[piece], len(word) + 1
    alpha, beta = np.full(size + 1, -np.inf), np.full(size + 1, -np.inf)
    alpha[0] = beta[size] = 0
    order = np.argsort(end, kind="stable")
    cuts = np.searchsorted(end[order], np.arange(size + 2))
    for j in range(1, size + 1):
        at = order[cuts[j] : cuts[j + 1]]
        alpha[j] = np.logaddexp.reduce(alpha[start[at]] + log_p[at])
    order = np.argsort(start, kind="stable")
    cuts = np.searchsorted(start[order], np.arange(size + 2))
    for j in range(size - 1, -1, -1):
        at = order[cuts[j] : cuts[j + 1]]
        beta[j] = np.logaddexp.reduce(beta[end[at]] + log_p[at])
    return piece, np.exp(alpha[start] + log_p + beta[end] - alpha[size])


def expected_pieces(words: list[str], lang: np.ndarray, n: np.ndarray, p: np.ndarray, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(cell, count) of the pieces that the words, each n times, are expected to hold; cell: language times the rows of p plus the piece."""
    cells, weights = [np.zeros(0, np.int64)], [np.zeros(0)]
    for k in (k for k, w in enumerate(words) if len(w) > _LONG):
        piece, weight = _long_expected(words[k], p[:, lang[k]], vocabulary)
        cells.append(lang[k] * len(p) + piece)
        weights.append(weight * n[k])
    short = [k for k, w in enumerate(words) if len(w) <= _LONG]
    if short:
        lang, n = lang[short], n[short]
        lattice = Lattice([words[k] for k in short], vocabulary)
        lattice.piece = lang[lattice.word] * len(p) + lattice.piece
        q = p.T.reshape(-1, 1)
        alpha, beta = lattice.forward(q)[..., 0], lattice.backward(q)[..., 0]
        total = alpha[np.arange(len(n)), lattice.lengths]
        cells.append(lattice.piece)
        # The total divides first: both sums are within range, their product need not be.
        weights.append(alpha[lattice.word, lattice.start] / total[lattice.word] * (q[lattice.piece, 0] * lattice.scale[:, 0]) * beta[lattice.word, lattice.end] * n[lattice.word])
    cell, at = np.unique(np.concatenate(cells), return_inverse=True)
    return cell, np.bincount(at, np.rint(np.concatenate(weights) * _UNIT)).astype(np.int64)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", pieces: list[str] | None = None, docs_per_lang: int = 1500, max_langs: int = 512, rounds: int = 3, smoothing: float = 30.0, seed: int = 5) -> LanguageModel:
    """Learns from rows with a language whose id is not held out.

    Bounds of the labelled sample: about ``docs_per_lang`` documents of a language (those with the smallest hashes), of which every word counts,
    and the ``max_langs`` languages with the most documents. The words stay in the shared folder; the driver holds pieces by languages.
    Rows without a text or with an empty one count for the language's share alone; repeated rows count as often as they occur. Without any labelled row
    no language is learned. Other columns are not read.
    """
    pieces = pieces or read_pieces()
    known = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where(F.col("lang").isNotNull() & ~held_out(F.col("id")))
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(max_langs).collect()}
    languages = sorted(counts)
    if not languages:
        return LanguageModel(pieces, [], np.zeros((len(pieces) + 1, 0)), np.zeros(0))
    share = F.create_map(*(F.lit(x) for lang in languages for x in (lang, min(1.0, docs_per_lang / counts[lang]))))
    sample = known.where(seeded(F.col("id"), seed) / float(1 << 52) < share[F.col("lang")])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from collections import Counter

        worker_store(None)
        for batch in batches:
            for i in range(0, batch.num_rows, 200):
                seen: Counter = Counter()
                for lang, text in zip(*(batch.column(k).slice(i, 200).to_pylist() for k in (0, 1)), strict=True):
                    for w in words_of(text):
                        seen[lang, w] += 1
                if seen:
                    yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen]), pa.array([k[1] for k in seen]), pa.array(list(seen.values()), pa.int64())], names=["lang", "word", "n"])

    words = sample.select("lang", "text").mapInArrow(split, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    # So many files that all cores have some, whatever adaptive execution would merge.
    words = written(words.repartition(64), "words")
    vocabulary, place = Vocabulary(pieces), {lang: k for k, lang in enumerate(languages)}

    def counter(p: np.ndarray):
        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            worker_store(None)
            for batch in batches:
                for i in range(0, batch.num_rows, 4000):
                    lang, word, n = (batch.column(k).slice(i, 4000).to_pylist() for k in range(3))
                    found = expected_pieces(word, np.array([place[x] for x in lang]), np.array(n, dtype=float), p, vocabulary)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["cell", "n"])

        return count

    p = np.full((len(pieces) + 1, len(languages)), 1 / len(pieces))
    for _ in range(rounds):
        p[-1] = _FLOOR**0.5
        counted = words.mapInArrow(counter(p), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
        expected = np.zeros(p.size)
        expected[np.asarray(counted["cell"])] = np.asarray(counted["n"]) / _UNIT
        expected = expected.reshape(len(languages), -1).T
        of_all = expected.sum(axis=1, keepdims=True) + 0.01
        p = (expected + smoothing * of_all / of_all.sum()) / (expected.sum(axis=0) + smoothing)
    p = np.maximum(p, _FLOOR)
    p[-1] = _FLOOR**0.5
    n = np.array([counts[x] for x in languages], dtype=float)
    return LanguageModel(pieces, languages, p, np.log(n / n.sum()))


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text", slice_rows: int = 200) -> DataFrame:
    """docs with lang_pred and score, the posterior of the prediction; columns of docs that bear these names are replaced.

    A text that is null, empty or without a letter is ``und`` with score 0, as is every text if no language was learned.
    Whole texts are scored, whatever their length, repeated rows each. An empty table gives an empty result.
    """
    columns = [c for c in docs.columns if c not in ("lang_pred", "score")]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in columns)
    # The text goes to the workers once.
    inputs = [F.col(f"`{c}`") for c in columns] + ([] if text_col in columns else [F.col(text_col).alias("the text")])
    at = columns.index(text_col) if text_col in columns else len(columns)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, slice_rows):
                part = batch.slice(i, slice_rows)
                found = model.identify(part.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns[: len(columns)], pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], names=[*columns, "lang_pred", "score"])

    return docs.select(*inputs).mapInArrow(score, ", ".join(filter(None, (fields, "lang_pred string, score double"))))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs)
    return identify(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score")
