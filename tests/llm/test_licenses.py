"""License spans against plain searches over the words of every text."""

import random
import re

import pyarrow as pa
import pytest

from quarry.llm import licenses as L
from quarry.llm import wordscan

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def places(text):
    """(start, label) of every phrase, base contract."""
    ws = words(text)
    return sorted((i, t.label) for t in L.PHRASES for p in [t.text.split()]
                  for i in range(len(ws) - len(p) + 1) if ws[i:i + len(p)] == p)


def distance(a, b):
    """Least edit distance of ``a`` to any stretch of ``b``."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def true_labels(text):
    out = {label for _, label in places(text)}
    for t in L.NOTICES:
        p = t.text.split()
        if distance(p, words(text)) <= L.edits_of(len(p), False):
            out.add(t.label)
    return ",".join(sorted(out))


def brute(docs):
    out = []
    for i, text in docs:
        at = places(text)
        out.append((i, len(words(text)), len(at), at[0][0] if at else None,
                    at[-1][0] if at else None, ",".join(sorted({x for _, x in at})),
                    true_labels(text)))
    return sorted(out, key=repr)


def some_docs(n, seed):
    rng = random.Random(seed)
    filler = ["alpha", "the", "license", "under", "by", "nc", "cc", "Mit", "é", "2", "version"]

    def edited(text):
        ws = text.split()
        for _ in range(rng.randint(0, 5)):
            i = rng.randrange(len(ws))
            ws[i:i + 1] = rng.choice([["changed"], [], [ws[i], "more"]])
        return " ".join(ws)

    docs = []
    for i in range(n):
        parts = [" ".join(rng.choices(filler, k=rng.randint(0, 40)))]
        if rng.random() < 0.7:
            parts.append(edited(rng.choice(L.NOTICES).text).upper())
        if rng.random() < 0.3:
            parts.append(rng.choice(L.PHRASES).text.replace(" ", rng.choice([" ", "-", ", \n"])))
        rng.shuffle(parts)
        docs.append((i, rng.choice([" ", ". "]).join(parts)))
    return docs


def query(spark, tmp_path, docs):
    from quarry.llm.queries import op11_licenses
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(
        str(tmp_path / "documents.parquet"))
    return [tuple(r) for r in op11_licenses(spark, str(tmp_path)).collect()]


def test_the_registered_query(spark, tmp_path):
    docs = some_docs(150, 1)
    docs += [(150, None), (151, ""), (152, "..."), (None, "cc by nc"), (153, "CC-BY-NC " * 500),
             (153, "CC-BY-NC " * 500), (154, "x " * 20_000 + "Under the MIT License."),
             (155, "cc by nc by nc cc by nc")] + [(200 + i, docs[0][1]) for i in range(40)]
    got = query(spark, tmp_path, docs)
    assert sorted((r[:-1] for r in got), key=repr) == brute(docs)
    assert all(0 <= r[-1] <= 1 and (r[-1] >= 0.8) == (r[6] != "") for r in got)


def test_empty_table_and_extra_columns(spark, frame):
    out = L.license_spans(frame([], "doc_id long, text string"))
    assert out.collect() == [] and out.columns == ["doc_id", "n_words", "spans"]
    docs = frame([(1, "Released under the MIT license")], "key long, h string",
                 ("spans", "id", "text", "pos", "template"))
    row = L.license_spans(docs, id_col="key", text_col="h").first()
    assert row["key"] == 1 and row["n_words"] == 5
    assert [(s["label"], s["start"], s["end"]) for s in row["spans"]] == [("mit", 1, 5)]


def test_templates_of_the_caller(spark, frame):
    docs = frame([(1, "one two three four"), (2, "two three")], "doc_id long, text string")
    out = {r["doc_id"]: r["spans"] for r in
           L.license_spans(docs, [L.Template("t", "two three four", exact=True)]).collect()}
    assert [(s["start"], s["base"]) for s in out[1]] == [(1, False)] and out[2] == []
    with pytest.raises(ValueError):
        L.license_spans(docs, [L.Template("t", "too short")])


def test_hashes_are_equal_for_equal_runs_only():
    texts = [t for _, t in some_docs(60, 3)]
    found = wordscan.scan(pa.array(texts))
    text, pos, h = L.run_hashes(found, 3)
    named = {}
    for t, p, x in zip(text.tolist(), pos.tolist(), h.tolist()):
        named.setdefault(x, set()).add(" ".join(words(texts[t])[p:p + 3]))
    assert all(len(v) == 1 for v in named.values())
    assert len({next(iter(v)) for v in named.values()}) == len(named)
    assert len(h) == sum(max(0, len(words(t)) - 2) for t in texts)


def test_a_large_template_table_is_joined_without_a_broadcast(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(L, "BROADCAST_RUNS", 1)
    docs = some_docs(30, 4)
    assert sorted((r[:-1] for r in query(spark, tmp_path, docs)), key=repr) == brute(docs)
