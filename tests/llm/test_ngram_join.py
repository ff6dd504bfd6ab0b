from __future__ import annotations

import random
import re
from itertools import combinations

import numpy as np
import pytest

from gridloom.llm import common, ngram_join


def word_set(text, width):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return set()
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if len(words) >= width else {tuple(words)}


def brute(rows, width, percent):
    sets = [word_set(t, width) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    links = [0] * len(rows)
    for a, b in combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            parent[root(a)] = root(b)
            links[a] += 1
            links[b] += 1
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(d, least.get(root(i), d))
    return sorted((d, len(sets[i]), least[root(i)], links[i]) for i, (d, _) in enumerate(rows))


def found(df, width, percent):
    return sorted(tuple(r) for r in ngram_join.classes(df, width, percent).collect())


@pytest.mark.parametrize(("width", "percent"), [(4, 85), (5, 80)])
def test_matches_brute_force_on_the_small_table(documents, width, percent):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    assert found(documents, width, percent) == brute(rows, width, percent)


def test_edges_of_the_threshold_and_chains(make):
    random.seed(3)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for family in range(12):
        base = random.choices(words, k=random.choice([4, 7, 12, 30, 90]))
        for _ in range(8):
            base = list(base)
            for _ in range(random.choice([0, 1, 1, 2])):
                base[random.randrange(len(base))] = random.choice(words)
            rows.append((len(rows) * 3 + family % 2, " ".join(base)))
    rows += [(9000, None), (9001, ""), (9002, " \n"), (9003, "one two"), (9004, "ONE  two"), (9005, "one two three"), (9006, "É x"), (9007, "é x")]
    df = make(rows)
    assert found(df, 4, 85) == brute(rows, 4, 85)
    assert found(df, 2, 50) == brute(rows, 2, 50)


def test_blocks_of_a_large_component(make, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", 4)
    random.seed(5)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(60):
        own = base[: random.choice([48, 52, 56, 60])]
        own[random.randrange(len(own))] = f"x{i}"
        rows.append((i, " ".join(own)))
    assert found(make(rows), 4, 85) == brute(rows, 4, 85)


def test_hot_shingles_come_last_and_lose_nothing(make, monkeypatch):
    monkeypatch.setattr(ngram_join, "HOT_LEAST", 3)
    random.seed(6)
    base = " ".join(f"w{i}" for i in range(50))
    rows = [(i, f"{base} a{i // 2} b{i // 2} c{i}") for i in range(40)] + [(100 + i, " ".join(f"u{i}v{j}" for j in range(30)) + " " + base[:60]) for i in range(40)]
    assert found(make(rows), 4, 85) == brute(rows, 4, 85)


def test_every_link_of_a_large_group_is_counted(make):
    random.seed(8)
    base = [f"w{i}" for i in range(80)]
    rows = []
    for i in range(150):
        own = list(base)
        for _ in range(random.choice([0, 1, 2])):
            own[random.randrange(80)] = f"x{random.randrange(30)}"
        rows.append((i, " ".join(own)))
    rows += [(1000 + i, rows[3][1]) for i in range(400)]
    assert found(make(rows), 4, 85) == brute(rows, 4, 85)


def test_hot_keys_are_looked_up_and_nulls_stay(spark):
    rows = common.stored(spark.createDataFrame([(1, i) for i in range(700)] + [(2, 5), (3, 6), (None, 7)], "key long, x long"))
    table = spark.createDataFrame([(1, "a"), (2, "b")], "key long, value string")
    hot = common.hot_keys(rows, "key")
    assert hot == [1]
    got = {(r.key, r.value) for r in common.looked_up(rows, "key", table, hot, "left").collect()}
    assert got == {(1, "a"), (2, "b"), (3, None), (None, None)}
    assert common.looked_up(rows, "key", table, hot).count() == 701


def test_empty_table_repeated_rows_and_long_text(make, spark):
    assert found(make([(1, "a b c d e")]).where("doc_id < 0"), 4, 85) == []
    long = " ".join(f"t{i}" for i in range(200_000))
    rows = [(5, "a b c d e"), (5, "a b c d e"), (2, long), (7, long + " z"), (None, "a b c d e")]
    assert found(make(rows), 4, 85) == [(2, 199_997, 2, 1), (5, 2, 5, 1), (5, 2, 5, 1), (7, 199_998, 2, 1)]


def test_components_of_a_path_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(40)] + [(1000, 1000 + i) for i in range(1, 60)]
    order = np.random.default_rng(1).permutation(3000)
    got = common.connected_components(spark.createDataFrame([(int(order[a]), int(order[b])) for a, b in edges], "a long, b long")).collect()
    groups = {}
    for r in got:
        groups.setdefault(r.component, set()).add(r.node)
    assert sorted(len(g) for g in groups.values()) == [41, 60]
    assert all(c in g for c, g in groups.items())
