"""The network's scores against a plain loop: one document, window, step and direction at a time."""

import math
import random

import numpy as np
import pyarrow as pa

from wirelark.llm import texts, toxicity


def logistic(v):
    return 1 / (1 + np.exp(-v))


def embeddings(net, words):
    """A row for each word of the text: its parts' rows, and the mean of its trigrams' rows."""
    out = []
    for u in words.which:
        grams = words.trigrams[words.first[u]:words.first[u + 1]]
        row = np.mean([net.w["table_tri"][g].astype(float) for g in grams], axis=0)
        for i, kind in enumerate(toxicity.KINDS):
            row = row + net.w[f"table_{kind}"][words.ids[u, i]]
        out.append(row)
    return out


def states(net, rows, d):
    h, size, out = np.zeros(net.settings.hidden), net.settings.hidden, []
    for x in rows if d == "f" else rows[::-1]:
        p = x @ net.w[f"in_{d}"].astype(float) + net.w[f"bias_{d}"]
        g = h @ net.w[f"rec_{d}"].astype(float)
        z, r = logistic(p[:size] + g[:size]), logistic(p[size:2 * size] + g[size:2 * size])
        n = np.tanh(p[2 * size:] + r * g[2 * size:])
        h = (1 - z) * n + z * h
        out.append(h)
    return out if d == "f" else out[::-1]


def plain_score(net, text):
    data, offsets = texts.column_bytes(pa.array([text], pa.string()))
    words, s, best = toxicity.read_words(data, offsets, net.settings.table_log2), net.settings, 0.0
    rows, windows = embeddings(net, words), 0
    begin = 0
    while rows and (begin == 0 or begin - s.stride + s.window < len(rows)):
        own = rows[begin:begin + s.window]
        both = [np.concatenate(pair) for pair in zip(states(net, own, "f"), states(net, own, "b"))]
        e = np.array([np.tanh(v @ net.w["att"].astype(float)) @ net.w["att_v"].astype(float) for v in both])
        a = np.exp(e - e.max())
        pooled = sum(w * v for w, v in zip(a / a.sum(), both))
        best = max(best, float(logistic(pooled @ net.w["out"].astype(float) + net.w["out_b"][0])))
        windows, begin = windows + 1, begin + s.stride
    return best, windows


def test_scores_of_whole_documents():
    draw = random.Random(4)
    vocabulary = ["".join(draw.choices("abcdefghij", k=draw.randint(1, 12))) for _ in range(60)] + ["ß", "Ünder", "7", "x"]
    net = toxicity.Network(toxicity.Settings(table_log2=10))
    w = net.settings.window
    documents = [None, "", " .,; ", "one", *(" ".join(draw.choices(vocabulary, k=n)) for n in (2, 9, w - 1, w, w + 1, 2 * w, 5 * w + 3))]
    data, offsets = texts.column_bytes(pa.array(documents, pa.string()))
    scores, windows = toxicity.document_scores(net, data, offsets)
    for text, score, n in zip(documents, scores, windows):
        want, count = plain_score(net, text)
        assert n == count and math.isclose(score, want, rel_tol=1e-4, abs_tol=1e-5), (text, score, want)
