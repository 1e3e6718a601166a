"""Each pipeline stage on its own input against a plain version that shares no code with it."""

import itertools
import random
import re

import pytest
import xxhash

import corpus_pipeline as C

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\W_]+")


def made(seed=5):
    rng = random.Random(seed)
    vocabulary = ["w" + "".join(rng.choices("abcdef", k=4)) for _ in range(400)]
    line = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    common = [line(12), line(30), line(6)]
    texts = []
    for d in range(60):
        parts = []
        for _ in range(rng.randint(1, 4)):
            words = list(rng.choice(common)) if rng.random() < 0.35 else line(rng.randint(1, 40))
            if rng.random() < 0.3:
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            parts.append(" ".join(words))
        if d % 9 == 0:
            parts.append(f'password = "s3cret{d}value"')
        texts.append("\n".join(parts))
    long = " ".join(line(200)).split()
    texts += [" ".join(long), " ".join([*long[:100], "other", *long[101:]]), "", None]
    return [(i, t, "en", f"s{i % 4}", len(t or "")) for i, t in enumerate(texts)]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return row[-1]


def groups(n, linked):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in itertools.combinations(range(n), 2):
        if linked(a, b):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def without_repeated_lines(docs):
    lines = [(i, n, x, [w.lower() for w in WORD.findall(x)]) for i, t in sorted(docs.items())
             for n, x in enumerate((t or "").split("\n")) if x.strip()]
    root = groups(len(lines), lambda a, b: distance(lines[a][3], lines[b][3])
                  <= 0.2 * max(len(lines[a][3]), len(lines[b][3])) + 1e-9)
    gone = {lines[x][:2] for x, r in enumerate(root) if x != r}
    out = {}
    for i, t in docs.items():
        left = "\n".join(x for n, x in enumerate((t or "").split("\n")) if (i, n) not in gone)
        lost = any(g[0] == i for g in gone)
        if not lost or WORD.search(left):
            out[i] = left if lost else t
    return out


def fingerprint(text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    grams = [" ".join(ws[k:k + 4]) for k in range(len(ws) - 3)] or ([" ".join(ws)] if ws else [])
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def one_of_each_group(docs):
    ids = sorted(docs)
    fps = [fingerprint(docs[i]) for i in ids]
    root = groups(len(ids), lambda a, b: bin(fps[a] ^ fps[b]).count("1") <= 4)
    return {i: docs[i] for x, i in enumerate(ids) if root[x] == x}


SECRET = re.compile(r"""((?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)"""
                    r"""([A-Za-z0-9+/_.=-]{6,})""", re.I | re.A)


@pytest.fixture(scope="module")
def texts():
    return made()


def held(df):
    rows = df.collect()
    assert all(r["n_chars"] == len(r["text"] or "") or r["text"] is None for r in rows)
    return {r["doc_id"]: r["text"] for r in rows}


def test_line_dedup(spark, texts):
    got = held(C.dedup_lines(spark, spark.createDataFrame(texts, DOCUMENTS), ""))
    want = without_repeated_lines({r[0]: r[1] for r in texts})
    assert got == want and sum((r[1] or "") != (want.get(r[0]) or "") for r in texts) > 10


def test_simhash_near_dedup(spark, texts):
    docs = texts + [(100 + r[0], r[1], *r[2:]) for r in texts[:5]]
    got = held(C.dedup_documents(spark, spark.createDataFrame(docs, DOCUMENTS), ""))
    want = one_of_each_group({r[0]: r[1] for r in docs})
    assert got == want and 5 <= len(docs) - len(want) < 15


def test_secret_scan(spark, texts):
    got = held(C.mask_secrets(spark, spark.createDataFrame(texts, DOCUMENTS), ""))
    assert set(got) == {r[0] for r in texts}
    for i, t, *_ in texts:
        masked = SECRET.sub(r"\1[secret]", t or "")
        # the field may add marks to those of the patterns, and leaves texts without any alone
        assert (got[i] or "") == masked or "[secret]" in masked
    assert sum("[secret]" in (t or "") for t in got.values()) >= 6


def test_best_fit_packing(spark, texts):
    rows = C.pack_documents(spark, spark.createDataFrame(texts, DOCUMENTS), "").collect()
    size = {i: len(re.findall(r"\w+|[^\w\s]", t or "")) for i, t, *_ in texts}
    source = {r[0]: r[3] for r in texts}
    told, bins = {}, {}
    for r in rows:
        told[r["doc_id"]] = told.get(r["doc_id"], 0) + r["length"]
        if r["bin"] is not None:
            bins.setdefault(r["bin"], []).append(r)
    assert told == size
    for held_ in bins.values():
        held_ = sorted(held_, key=lambda r: r["offset"])
        assert [r["offset"] for r in held_] == [sum(x["length"] for x in held_[:n])
                                               for n in range(len(held_))]
        assert sum(r["length"] for r in held_) <= 2048
        assert len({source[r["doc_id"]] for r in held_}) == len(held_)


def test_toxicity(spark, tmp_path):
    rng = random.Random(2)
    plain = ["w%d" % i for i in range(300)]
    docs, labels, bad = [], [], set()
    for d in range(500):
        words = [rng.choice(plain) for _ in range(rng.randint(20, 80))]
        if d % 4 == 0:
            bad.add(d)
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(["vile", "nasty", "awful"]))
        docs.append((d, " ".join(words), "en", "s", 0))
        labels.append((d, 1, int(d in bad)))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(
        str(tmp_path / "labels.parquet"))
    kept = C.drop_toxic(spark, spark.createDataFrame(docs, DOCUMENTS), str(tmp_path))
    ids = {r["doc_id"] for r in kept.collect()}
    clean = {d[0] for d in docs} - bad
    assert len(ids & clean) >= 0.97 * len(clean) and len(ids & bad) <= 0.05 * len(bad)
