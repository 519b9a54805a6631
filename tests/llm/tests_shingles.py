"""Shingles of five words as tuples."""


def shingles(text):
    w = (text or "").split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def similar(a, b):
    x, y = shingles(a), shingles(b)
    return bool(x & y) and len(x & y) / len(x | y) >= 0.8


def contains_item(text, item):
    s = shingles(item)
    return bool(s) and len(s & shingles(text)) / len(s) >= 0.8
