import itertools
import random

import numpy as np

from quarry.llm import lines as L


def _levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_bit_parallel_distance():
    rng = random.Random(1)
    for _ in range(400):
        a = [rng.randrange(4) for _ in range(rng.randrange(40))]
        b = list(a) if rng.random() < 0.5 else [rng.randrange(4) for _ in range(rng.randrange(40))]
        for _ in range(rng.randrange(4)):
            b.insert(rng.randrange(len(b) + 1), rng.randrange(4))
        assert L.word_edit_distance(np.array(a), np.array(b)) == _levenshtein(a, b)


def test_pairs_within_the_radius_share_exactly_one_first_key():
    rng = random.Random(2)
    table, masks = L.key_table(3), L.block_masks(3)
    assert sum(masks) == (1 << 64) - 1
    for _ in range(300):
        diff = sum(1 << b for b in rng.sample(range(64), rng.randrange(4)))
        same = [k for k, m in enumerate(masks) if not diff & m]
        assert len(same) >= L.AGREE and table[sum(1 << k for k in same[:L.AGREE])] >= 0


def _brute(rows):
    """(id, line) of all lines that go."""
    spots, words = [], {}
    for doc, text in rows:
        for n, line in enumerate((text or "").split("\n")):
            seq = tuple(L.word_hash(w) for w in L.WORD.findall(line))
            if len(seq) >= 5:
                spots.append(((doc is not None, doc or 0, n), seq))
                words.setdefault(seq, len(words))
    seqs = list(words)
    if not seqs:
        return set()
    _, sims = L.line_marks(np.concatenate([np.array(s) for s in seqs]),
                           np.concatenate(([0], np.cumsum([len(s) for s in seqs]))))
    root = list(range(len(seqs)))
    for i, j in itertools.combinations(range(len(seqs)), 2):
        if np.bitwise_count(sims[i] ^ sims[j]) <= 3 and _levenshtein(
                seqs[i], seqs[j]) <= 0.2 * max(len(seqs[i]), len(seqs[j])) + 1e-9:
            a, b = L._find(root, i), L._find(root, j)
            root[max(a, b)] = min(a, b)
    first, gone = {}, set()
    for spot, seq in sorted(spots):
        kept = first.setdefault(L._find(root, words[seq]), spot)
        if kept != spot:
            gone.add(spot)
    return gone


def _rows(seed=4):
    rng = random.Random(seed)
    vocabulary = ["word%s" % chr(97 + i % 26) * (1 + i // 26) for i in range(200)]
    line = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    common = [line(rng.randrange(5, 90)) for _ in range(12)]
    rows = []
    for d in range(50):
        text = []
        for _ in range(rng.randrange(6)):
            words = list(rng.choice(common)) if rng.random() < 0.5 else line(rng.randrange(30))
            if rng.random() < 0.4 and words:
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            text.append(" ".join(words).title() if rng.random() < 0.3 else " ".join(words))
        rows.append((d, "\n".join(text)))
    return rows + [(None, "one two three four five six"), (77, "One  two, three four five SIX!"),
                   (78, None), (79, ""), (80, "few words"), (81, "few words"),
                   (82, "item 12 of 99 in the list"), (83, "item 7 of 55 in the list\n" * 3)]


def test_lines_equal_brute_force(frame):
    rows = _rows()
    docs = frame(rows, "doc_id long, text string", clash=("key", "sim", "th", "line", "gone"))
    for block in (2, 2048):
        got = {(r.doc_id is not None, r.doc_id or 0, n)
               for r in L.mark_lines(docs, block=block).collect() for n in r.removed}
        want = _brute(rows)
        assert got == want and len(want) > 20


def test_documents_of_nothing_but_repeats_go_and_columns_stay(frame):
    line = "this is a line of several words"
    docs = frame([(1, line + "\nshort", "s"), (2, line, "s"), (3, line + "\nand more words", "s"),
                  (4, None, "s"), (5, "", "s")], "doc_id long, text string, source string",
                 clash=("lost", "key", "name"))
    kept = L.drop_lines(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [
        (1, line + "\nshort"), (3, "and more words"), (4, None), (5, "")]


def test_repeated_rows_are_one_document_and_empty_tables_work(frame):
    docs = frame([(1, "a line of at least five words")] * 2, "doc_id long, text string")
    assert [list(r.removed) for r in L.mark_lines(docs).collect()] == [[], []]
    empty = frame([], "doc_id long, text string")
    assert L.mark_lines(empty).count() == 0 and L.drop_lines(empty).count() == 0


def _links(lines):
    """Component of each line by plain edit similarity of its words, with no other bound."""
    words = [[w.lower() for w in L.tokens(x)] or [x.strip()] for x in lines]
    root = list(range(len(lines)))
    for i, j in itertools.combinations(range(len(lines)), 2):
        if _levenshtein(words[i], words[j]) <= 0.2 * max(len(words[i]), len(words[j])) + 1e-9:
            a, b = L._find(root, i), L._find(root, j)
            root[max(a, b)] = min(a, b)
    return [L._find(root, i) for i in range(len(lines))]


def _gone(frame, lines, **options):
    docs = frame(list(enumerate(lines)), "doc_id long, text string")
    return {r.doc_id for r in L.mark_lines(docs, **L.WHOLE, **options).collect() if r.removed}


def _edited(rng, words, vocabulary, n):
    words = list(words)
    for _ in range(n):
        x = rng.randrange(len(words))
        kind = rng.randrange(3)
        if kind == 0:
            words[x] = rng.choice(vocabulary)
        elif kind == 1:
            words.insert(x, rng.choice(vocabulary))
        elif len(words) > 1:
            del words[x]
    return words


def test_all_lines_within_the_similarity_are_found(frame):
    """Edits of up to a fifth of the words and some more, in a vocabulary of common runs too."""
    for seed, size in ((1, 12), (2, 4000)):
        rng = random.Random(seed)
        vocabulary = ["w" + "".join(rng.choices("abcdefgh", k=5)) for _ in range(size)]
        lines = []
        for n in [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 14, 19, 20, 31, 50, 77]:
            base = rng.choices(vocabulary, k=n)
            lines += [" ".join(_edited(rng, base, vocabulary, rng.randrange(n // 4 + 2)))
                      for _ in range(9)]
        rng.shuffle(lines)
        roots = _links(lines)
        want = {i for i, r in enumerate(roots) if i != r}
        assert len(want) > 40
        for block in (4, 2048):
            assert _gone(frame, lines, block=block) == want


def test_lines_that_differ_in_digits_only_are_not_repeats(frame):
    lines = ["12 45 78 90 33", "99 10 27 64 58", "12 45 78 90 34", "12 45 78 90 33",
             "on 2024 01 05 it was 31 out of 99", "on 1987 12 24 it was 70 out of 11"]
    assert _gone(frame, lines) == {2, 3}


def test_short_lines_and_scripts_without_blanks(frame):
    lines = ["Share this page", "share  this page!", "-----", " ----- ", "=====", "", " ",
             "今天天气很好我们去公园散步", "今天天气很好我们去公园跑步", "我不知道他昨天为什么没有来"]
    assert _gone(frame, lines) == {1, 3, 8}
    kept = L.drop_lines(frame([(1, "Menu\na b"), (2, "Menu"), (3, "Menu\n\nc d")],
                              "doc_id long, text string"), **L.WHOLE)
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(1, "Menu\na b"), (3, "\nc d")]


def test_pairs_of_a_large_group_come_in_slices():
    starts = np.array([0, 3, 3, 4, 60, 62])
    found = list(L.slices(starts, 100))
    assert max(len(a) for a, _ in found) <= 100
    pairs = sorted((x, y) for a, b in found for x, y in zip(a.tolist(), b.tolist()))
    assert pairs == sorted(p for s, t in itertools.pairwise(starts.tolist())
                           for p in itertools.combinations(range(s, t), 2))


def test_many_lines_of_one_simhash_are_one_group(frame):
    """Long lines with one word changed: few SimHashes, and no task gets all of their lines."""
    rng = random.Random(5)
    base = ["word%d" % rng.randrange(10 ** 6) for _ in range(400)]
    lines = []
    for x in range(300):
        words = list(base)
        words[rng.randrange(400)] = "other%d" % x
        lines.append(" ".join(words))
    assert _gone(frame, lines, block=16) == set(range(1, 300))


def test_words_whose_short_hashes_are_equal_are_no_repeats(frame):
    """Pairs of words that share 31 bits of CRC-32."""
    pairs = [("2115267360", "9869345094"), ("2177247658", "9817825902"),
             ("gxyrfedqvk", "yttaivkgvx"), ("abflknzllu", "hlsnjhddhy")]
    rows = [(i, w) for i, w in enumerate(w for p in pairs for w in p)]
    docs = frame(rows, "doc_id long, text string")
    assert L.drop_lines(docs, **L.WHOLE).count() == len(rows)
    assert all(not r.removed for r in L.mark_lines(docs, **L.WHOLE).collect())


def test_words_and_lines_have_names_of_their_own():
    memory = L.Words()
    words = [str(10**9 + 7 * i) for i in range(200_000)] + [f"w{i}" for i in range(100_000)]
    names = {memory[w] for w in words}
    assert len(names) == len(words) and min(names) >= 0
    one = np.array(sorted(names)[:50_000])
    bounds = np.arange(0, len(one) + 1, 5)
    assert len(set(L.line_keys(one, bounds)) & set(L.line_keys(one, bounds, True))) == 0


def test_whole_lines_with_extra_columns(frame):
    docs = frame([(1, "a b c d e f g h i j"), (2, "a b c d e f g h i k"), (None, None)],
                 "doc_id long, text string",
                 clash=("key", "key2", "run", "n", "p", "r", "th", "id", "line"))
    kept = L.drop_lines(docs, **L.WHOLE)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1]


def test_no_table_of_lines_is_broadcast(spark, frame, monkeypatch):
    """Stored keys and links compress to less than they hold; small here, all would be broadcast."""
    from quarry.llm.shared import Scratch
    plans, keep = [], Scratch.keep

    def kept(self, df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return keep(self, df, name)
    monkeypatch.setattr(Scratch, "keep", kept)
    words = [f"w{i}" for i in range(12)]
    lines = [" ".join(words), " ".join([*words[:11], "x"]), " ".join(["y", *words[1:]]), "else"]
    gone = L.repeated_lines(frame([(1, "\n".join(lines)), (2, lines[0])],
                                  "doc_id long, text string"), **L.WHOLE)
    plans.append(gone._jdf.queryExecution().executedPlan().toString())
    assert sorted(map(tuple, gone.select("id", "line").collect())) == [(1, 1), (1, 2), (2, 0)]
    joined = [p for p in plans if "Join" in p]
    assert len(joined) > 5
    for plan in joined:
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
