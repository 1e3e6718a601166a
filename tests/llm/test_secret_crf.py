import itertools
import random
import re

import numpy as np

from quarry.llm import secret_crf as S

KINDS = [("assign", re.compile(r"(?ai:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]"
                               r"\x20*[\"']?([A-Za-z0-9+/_.=-]+)"), 2, 6),
         ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20), ("hex", re.compile(r"[0-9a-f]+"), 0, 24)]


def _brute(text):
    return sorted((m.start(), k, m.end()) for k, (_, p, g, n) in enumerate(KINDS)
                  for m in p.finditer(text or "") if len(m.group(g)) >= n)


def _text(rng):
    hexed = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    parts = ["plain words", "é ü", "PASSWORD", "api_key=", "apikey :'", "token = \"", "secret:",
             "passwd==", "AKIA" + "Z9" * rng.randrange(12), hexed(rng.randrange(40)), "\n", "=", ":",
             "AKIAAKIA", "abc", "12345", "ſecret=", "toKen=abcdefg", "feed" * rng.randrange(9)]
    return rng.choice(["", " "]).join(rng.choice(parts) for _ in range(rng.randrange(14)))


def test_base_spans_equal_the_patterns():
    rng = random.Random(1)
    for _ in range(3000):
        text = _text(rng)
        assert [(a, k, b) for a, k, b, _, _ in S.base_spans(text)] == _brute(text)


def _random_field(seed):
    rng = np.random.default_rng(seed)
    moves = rng.normal(size=(3, 3))
    moves[S.OUTSIDE, S.INSIDE] = -20
    return S.Field(rng.normal(size=(S.FEATURES, 3)), moves)


def test_viterbi_and_pruning_equal_all_paths():
    rng = random.Random(2)
    for seed in range(40):
        field = _random_field(seed)
        memory = S.Tokens(field.weights)
        text = " ".join(rng.choice(["key", "a1b2", "=", "Word", "x" * 14, "\n"])
                        for _ in range(rng.randrange(1, 12)))
        tokens = [m for m in S.TOKEN.finditer(text)]
        scores = memory.scores([m.group() for m in tokens], text)
        spans, at = [], 0
        for line in [list(g) for nl, g in itertools.groupby(
                range(len(tokens)), key=lambda i: tokens[i].group() == "\n") if not nl]:
            best = max(itertools.product(range(3), repeat=len(line)), key=lambda tags: sum(
                scores[i][t] + field.moves[p, t]
                for i, t, p in zip(line, tags, (S.OUTSIDE, *tags))))
            for i, t in zip(line, best):
                before = best[line.index(i) - 1] if line.index(i) else S.OUTSIDE
                if t == S.BEGIN or t == S.INSIDE and before == S.OUTSIDE:
                    spans.append([tokens[i].start(), tokens[i].end()])
                elif t == S.INSIDE:
                    spans[-1][1] = tokens[i].end()
        assert [list(s) for s in field.spans(text, memory)] == spans


def _docs(n=300, seed=3):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("etaoinshr") for _ in range(rng.randrange(2, 9)))
    out = []
    for d in range(n):
        words = [word() for _ in range(rng.randrange(3, 60))]
        if d % 3 == 0:
            value = "".join(rng.choice("0123456789abcdef") for _ in range(40))
            name = "access_code" if d % 30 == 0 else "token"
            words.insert(rng.randrange(len(words)), f'{name} = "{value.upper()}"')
        out.append((d, " ".join(words)))
    return out


def test_the_field_adds_spans_and_leaves_clean_text(frame):
    docs = _docs() + [(None, "token=abcdef123"), (900, None), (901, ""), (900, None)]
    table = frame(docs, "doc_id long, text string", clash=("secrets", "key", "_secrets"))
    field = S.learn(table)
    got = S.scan(table, field).collect()
    assert len(got) == len(docs)
    for r in got:
        spans = [(s.start, S.KINDS.index(s.kind), s.end) for s in r.secrets]
        assert spans == sorted(spans)
        if r.doc_id is not None and r.doc_id < 300:
            assert [s for s in spans if s[1] < 3] == _brute(dict(docs)[r.doc_id])
            if r.doc_id % 3:
                assert not spans
    added = [r for r in got if r.doc_id is not None and r.doc_id % 30 == 0 and r.doc_id < 300
             and any(s.kind == "crf" for s in r.secrets)]
    assert len(added) >= 8
    red = {r.doc_id: r.text for r in S.redact(table, field).collect()}
    assert red[900] is None and red[901] == "" and red[None] == "token=[secret]"
    assert red[1] == docs[1][1] and 'token = "[secret]"' in red[3]


def test_without_secrets_nothing_is_tagged(frame):
    docs = frame([(1, "plain text only"), (2, None)], "doc_id long, text string")
    field = S.learn(docs)
    assert all(not r.secrets for r in S.scan(docs, field).collect())
    assert S.scan(docs.limit(0), S.learn(docs.limit(0))).count() == 0
