"""op10's predictions against a plain count of n-grams, byte by byte."""

import re

import numpy as np

from wirelark.llm import langid, queries

SF = "/root/testdata/sf0.001"


def grams(text):
    """Windows of four bytes of the folded text, between blanks, whose middle bytes are letters."""
    folded = bytearray(langid._FOLD[b] for b in text.encode())
    raw = text.encode()
    for i in range(1, len(raw)):
        if raw[i - 1] == 0xC3 and 0x80 <= folded[i] <= 0x9E and folded[i] != 0x97:
            folded[i] += 32
    padded = bytes([langid._SPACE, *folded, langid._SPACE, langid._SPACE])
    return [padded[i:i + 4] for i in range(len(padded) - 3) if padded[i + 1] != langid._SPACE and padded[i + 2] != langid._SPACE]


def in_filter(model, bit, gram):
    value, shift = int.from_bytes(gram, "little"), 32 - model.settings.slots_log2
    for k in range(model.settings.hashes):
        slot = ((value ^ (value >> (15 + k))) * int(langid._MULTIPLIERS[k])) % 2 ** 32 >> shift
        if not int(model.masks[bit // 64][slot]) >> (bit % 64) & 1:
            return False
    return True


def predict(model, text):
    """(language, score) from the corrected number of n-grams in each language's filter."""
    if not re.search(r"[^\W\d_]", text or ""):
        return "und", 0.0
    found = grams(text)
    hits = []
    for bit in range(len(model.languages)):
        seen = sum(in_filter(model, bit, g) for g in found)
        hits.append(max(0.0, (seen - len(found) * model.chance[bit]) / (1 - model.chance[bit])))
    best = int(np.argmax(hits))
    second = max([h for i, h in enumerate(hits) if i != best], default=0.0)
    return model.languages[best], hits[best] / max(hits[best] + second, 1e-9)


def test_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    model = langid.fit(docs.where(~langid.held_out()))
    text = {r.doc_id: r.text for r in docs.collect()}
    rows = queries.op10_language(spark, SF).collect()
    assert len(rows) == len(text)
    for r in rows:
        lang, score = predict(model, text[r.doc_id])
        assert (r.lang_pred, round(r.score, 9)) == (lang, round(score, 9)), r.doc_id
