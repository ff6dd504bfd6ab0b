from __future__ import annotations

import random
import re

import numpy as np

from gridloom.llm import passages


def prose(random, n):
    return [f"{random.choice('abcdefgh')}{random.randrange(3000)}" for _ in range(n)]


def test_windows_are_those_of_the_definition():
    values = np.random.default_rng(2).permutation(80).astype(np.uint64)
    got = passages.compact_windows(values, 10)
    for a in range(80):
        for b in range(a + 10, 81):
            c = a + int(values[a:b].argmin())
            assert sum(w[1] == c and w[0] <= a and b - 1 <= w[2] for w in got) == 1
    assert all(r - low + 1 >= 10 for low, _, r in got)


def test_stretches_need_enough_functions():
    k, low, high = np.array([0, 1, 1, 2]), np.array([0, 30, 95, 300]), np.array([100, 90, 200, 400])
    assert passages.stretches(k, low, high, 20) == [(30, 90)]
    assert passages.stretches(np.array([3, 3]), np.array([0, 0]), np.array([99, 99]), 20) == []


def test_planted_passages_are_found_and_clean_documents_left(make):
    rnd = random.Random(4)
    passage, near, short = prose(rnd, 60), prose(rnd, 120), prose(rnd, 40)
    rows, holders, near_holders = [], {}, {}
    for i in range(120):
        words = prose(rnd, rnd.choice([70, 150, 400]))
        at = rnd.randrange(len(words))
        if i % 10 == 0:
            words[at:at] = passage
            holders[i] = at
        elif i % 10 == 1:
            copy = list(near)
            copy[rnd.randrange(15, 105)] = "changed"
            words[at:at] = copy
            near_holders[i] = at
        elif i % 10 == 2:
            words[at:at] = short
        rows.append((i, " ".join(words)))
    rows += [(500, rows[5][1]), (501, rows[5][1].upper()), (502, None), (503, ""), (504, " ".join(passage[:20] * 8)), (505, " ".join(["same"] * 300)), (None, rows[5][1])]
    got = passages.repeated(make(rows)).collect()
    places = {}
    for r in got:
        places.setdefault(r.doc_id, []).append((r.start_word, r.n_words))
    assert set(places) == {*holders, *near_holders, 5, 500, 501}
    for i, at in holders.items():
        assert any(abs(s - at) <= 5 and abs(n - 60) <= 8 for s, n in places[i])
    for i, at in near_holders.items():
        assert any(at - 9 <= s and s + n <= at + 129 and n >= 50 for s, n in places[i])
    assert (0, len(rows[5][1].split())) in places[500]
    assert {(r.doc_id, r.other_id) for r in got} == {(r.other_id, r.doc_id) for r in got}


def test_empty_table(make):
    assert passages.repeated(make([(1, "x")]).where("doc_id > 3")).collect() == []


def lowered(text):
    return ["".join(c.lower() if c.isascii() else c for c in w) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]


def likeness(a, b):
    x, y = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a, b))
    return len(x & y) / len(x | y)


def test_passages_agree_with_brute_force_both_ways(spark):
    """Every word of an exact 50-word passage that another document holds is found; all that is found is a near copy."""
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    words = {r.doc_id: lowered(r.text) for r in documents.select("doc_id", "text").collect()}
    where = {}
    for d, own in words.items():
        for i in range(len(own) - 49):
            where.setdefault(tuple(own[i : i + 50]), set()).add((d, i))
    want, holders = {}, {}
    for places in where.values():
        if len({d for d, _ in places}) > 1:
            for d, i in places:
                want.setdefault(d, set()).update(range(i, i + 50))
    got = passages.repeated(documents).collect()
    for r in got:
        a, b = words[r.doc_id][r.start_word : r.start_word + r.n_words], words[r.other_id][r.other_start : r.other_start + r.other_words]
        assert r.doc_id != r.other_id and min(len(a), len(b)) >= 50 and len(a) == r.n_words and len(b) == r.other_words
        assert abs(likeness(a, b) - r.similarity) < 1e-9 and r.similarity >= 0.8
        holders.setdefault(r.doc_id, set()).update(range(r.start_word, r.start_word + r.n_words))
    assert want and set(want) <= set(holders)
    for d, own in want.items():
        assert own <= holders[d], (d, sorted(own - holders[d])[:5])


def near_pairs(rnd, n, blocked):
    """n pairs of near copies of 60 to 140 words, each after blocked documents with a part of the passage only."""
    rows, pairs = [], []
    for i in range(n):
        one = prose(rnd, rnd.randrange(60, 140))
        other = list(one)
        for _ in range(rnd.randrange(1, max(2, len(one) // 50))):  # an edit changes five shingles
            other[rnd.randrange(len(other))] = f"new{rnd.randrange(10**6)}"
        if likeness(one, other) < 0.8:
            other = one[:-1] + ["new"]
        own = [one[: (k := rnd.randrange(25, 45))] if j % 2 else one[-rnd.randrange(25, 45) :] for j in range(blocked)] + [one, other]
        rows += [(10 * i + j, " ".join([*prose(rnd, rnd.randrange(10, 60)), *part, *prose(rnd, rnd.randrange(10, 60))])) for j, part in enumerate(own)]
        pairs.append((10 * i + blocked, 10 * i + blocked + 1))
    return rows, pairs


def found_share(make, blocked, n=200):
    rows, pairs = near_pairs(random.Random(21 + blocked), n, blocked)
    got = {(r.doc_id, r.other_id) for r in passages.repeated(make(rows)).collect()}
    assert all(a // 10 == b // 10 for a, b in got)
    return sum(p in got for p in pairs) / len(pairs)


def test_recall_of_near_copies(make):
    assert found_share(make, 0) >= 0.95


def test_recall_of_near_copies_behind_documents_with_less(make):
    assert found_share(make, 1) >= 0.9
    assert found_share(make, 3) >= 0.85


def test_holders_of_a_passage_meet_past_documents_with_less_of_it(make):
    rnd = random.Random(9)
    rows, holders = [], []
    for i in range(40):
        passage = prose(rnd, 60)
        for j, part in enumerate((passage[: rnd.randrange(40, 50)], passage[-rnd.randrange(40, 50) :], passage, passage)):
            rows.append((10 * i + j, " ".join([*prose(rnd, rnd.randrange(20, 60)), *part, *prose(rnd, rnd.randrange(20, 60))])))
        holders.append((10 * i + 2, 10 * i + 3))
    got = passages.repeated(make(rows)).collect()
    assert {(r.doc_id, r.other_id) for r in got} == {*holders, *(h[::-1] for h in holders)}


def test_gaps_within_the_similarity_are_bridged():
    base = np.arange(96, dtype=np.uint32)
    for n in (9, 10):  # five or six adjacent words replaced, in 100
        edited = base.copy()
        edited[43 : 43 + n] += 1000
        assert passages.matches(base, edited, 46) == [(0, 96, 0, 96, (96 - n) / (96 + n))]
    longer = np.concatenate([base[:46], np.arange(2000, 2013, dtype=np.uint32), base[50:]])
    (found,) = passages.matches(longer, base, 46)
    assert found[:4] == (0, len(longer), 0, 96) and found[4] >= 0.8
    assert passages.matches(base, np.concatenate([base[:50], np.arange(3000, 3400, dtype=np.uint32), base[46:]]), 46) != []


def test_a_replaced_middle_leaves_a_near_copy(make):
    rnd = random.Random(12)
    rows = []
    for i in range(20):
        one = prose(rnd, 100)
        other = [*one[:47], *(f"new{rnd.randrange(10**6)}" for _ in range(5)), *one[52:]]
        rows += [(2 * i, " ".join(one)), (2 * i + 1, " ".join(other))]
    got = {(r.doc_id, r.other_id) for r in passages.repeated(make(rows)).collect()}
    assert sum((2 * i, 2 * i + 1) in got for i in range(20)) >= 15
    assert all(a // 2 == b // 2 for a, b in got)


def test_every_near_copy_is_found_behind_any_documents_with_less(make):
    assert found_share(make, 0) == 1
    assert found_share(make, 1) == 1
    assert found_share(make, 3) == 1


def test_no_prefix_misses_what_copies_have_in_common_first():
    rnd = np.random.default_rng(7)
    for _ in range(30):
        base = rnd.integers(0, 1 << 30, 90).astype(np.uint64)
        sides, kept = [], rnd.random(90) < 0.9
        for _ in range(2):
            side = base.copy()
            side[~kept & (rnd.random(90) < 0.5)] = rnd.integers(0, 1 << 30)
            sides.append(np.concatenate([rnd.integers(0, 1 << 30, 40).astype(np.uint64), side, rnd.integers(0, 1 << 30, 20).astype(np.uint64)]))
        rows = np.repeat([0, 1], 150)
        taken = passages.prefixes(np.concatenate(sides), rows, 46).reshape(2, 150)
        both = np.intersect1d(sides[0][40:130], sides[1][40:130])
        if len(both) >= 0.8 * max(len(np.unique(s[40:130])) for s in sides):
            for i in (0, 1):
                assert set(both[: passages.in_common(46)].tolist()) <= set(sides[i][taken[i]].tolist())


def test_all_that_is_linked_meets_along_a_chain(make):
    """Each text is a near copy of the next only: the links found connect all of them, whichever comes first."""
    rnd = random.Random(17)
    rows = []
    for i in range(20):
        words = prose(rnd, 100)
        order = list(range(8))
        rnd.shuffle(order)
        for j in range(8):
            rows.append((10 * i + order[j], " ".join([*prose(rnd, 30), *words, *prose(rnd, 30)])))
            words = list(words)
            words[10 * j + 12 : 10 * j + 14] = [f"new{rnd.randrange(10**6)}", f"new{rnd.randrange(10**6)}"]
    root = {d: d for d, _ in rows}
    for r in passages.repeated(make(rows)).collect():
        a, b = root[r.doc_id], root[r.other_id]
        root = {d: a if c == b else c for d, c in root.items()}
    assert len(set(root.values())) == 20


def test_alike_texts_of_repeated_words_are_no_candidates():
    """Texts that share only long runs of common words are no copies: the runs' shingles are in no prefix."""
    rnd = np.random.default_rng(5)
    often = np.arange(1, 9, dtype=np.uint64) << np.uint64(60)  # last in the order
    rows = []
    for _ in range(40):
        rows.append(np.concatenate([np.concatenate([np.full(20, x, np.uint64), rnd.integers(0, 1 << 30, 4).astype(np.uint64)]) for x in rnd.permutation(often)]))
    number = np.repeat(np.arange(40), [len(r) for r in rows])
    tokens = np.concatenate(rows)
    assert not np.isin(tokens[passages.prefixes(tokens, number, 46)], often).any()
    whole = np.full(60, often[0], np.uint64)
    assert passages.prefixes(whole, np.zeros(60, np.int64), 46).all()


def test_only_copies_of_one_shingle_need_no_second():
    tokens, row = np.array([1] * 46 + [2] * 45 + [3] + [2] * 46, np.uint64), np.repeat([0, 1], [91, 47])
    assert passages.constant(tokens, row, 46).tolist() == [True] * 46 + [False] * 46 + [True] * 46


def test_no_prefix_misses_what_texts_of_repeated_words_have_in_common():
    rnd, judged = np.random.default_rng(11), 0
    for _ in range(400):
        n, most = int(rnd.integers(1, 30)), int(rnd.integers(1, 40))
        base = rnd.integers(0, 1 << 30, n)[rnd.integers(0, n, 90)] if rnd.random() < 0.5 else np.repeat(rnd.integers(0, 1 << 30, 90), rnd.integers(1, most + 1, 90))[:90]
        sides, rows = [], []
        for _ in range(2):
            side = base.copy()
            for at in rnd.integers(0, 90, rnd.integers(0, 5)):
                side[at : at + rnd.integers(1, 4)] = rnd.integers(0, 1 << 30)
            sides.append(np.concatenate([rnd.choice(np.append(base, 7), 40), side, rnd.integers(0, 1 << 30, 20)]).astype(np.uint64))
        taken = passages.prefixes(np.concatenate(sides), np.repeat([0, 1], 150), 46).reshape(2, 150)
        both = np.intersect1d(sides[0][40:130], sides[1][40:130])
        if len(both) >= 0.8 * max(len(np.unique(s[40:130])) for s in sides):
            judged += 1
            for i in (0, 1):
                assert set(both[: passages.IN_COMMON].tolist()) <= set(sides[i][taken[i]].tolist())
    assert judged >= 100


def slow_matches(center, member, least):
    out, runs = [], [[i for i, x in enumerate(member) if x in set(center)]]
    split = lambda at: max(range(1, len(at)), key=lambda i: (at[i] - at[i - 1], -i))  # noqa: E731  at the widest gap, the first of such
    while runs:
        run = runs.pop()
        if not run or run[-1] - run[0] + 1 < least:
            continue
        own, parts = set(member[run[0] : run[-1] + 1]), []
        if len({member[i] for i in run}) >= 0.8 * len(own):
            parts = [[i for i, x in enumerate(center) if x in own]]
        while parts:
            far = parts.pop(max(range(len(parts)), key=lambda i: len(parts[i])))
            if far[-1] - far[0] + 1 < least:
                continue
            theirs = set(center[far[0] : far[-1] + 1])
            if len(own & theirs) >= 0.8 * len(own | theirs):
                out.append((far[0], far[-1] - far[0] + 1, run[0], run[-1] - run[0] + 1, len(own & theirs) / len(own | theirs)))
                break
            if len(own & theirs) >= 0.8 * len(own) and far[-1] - far[0] + 1 > len(far):
                parts += [far[: (k := split(far))], far[k:]]
        else:
            if run[-1] - run[0] + 1 > len(run):
                runs += [run[: (k := split(run))], run[k:]]
    return out


def test_matches_are_those_of_sets():
    rnd, found = np.random.default_rng(3), 0
    for _ in range(300):
        words = rnd.integers(0, rnd.choice([8, 60, 10**6]), 120)
        other = words.copy()
        for at in rnd.integers(0, 120, rnd.integers(0, 12)):
            other[at : at + rnd.integers(1, 6)] = rnd.integers(10**6, 10**7)
        other = np.concatenate([rnd.integers(0, 10**6, rnd.integers(0, 30)), other, words[: rnd.integers(0, 60)]])
        want = slow_matches(words.tolist(), other.tolist(), 20)
        assert passages.matches(words.astype(np.uint64), other.astype(np.uint64), 20) == want
        found += len(want)
    assert found >= 100
