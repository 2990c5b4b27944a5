"""Near duplicates against brute force on whole texts."""

import random
import re
import uuid

import numpy as np
import pytest

from trawlspark.llm import neardup

SCHEMA = "doc_id bigint, text string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text, width):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(text)
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(max(len(words) - width + 1, 1)))


def brute(rows, width, percent):
    sets = [shingle_set(t, width) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and min(len(a), len(b)) * 100 >= percent * max(len(a), len(b)):
                common = len(a & b)
                if 100 * common >= percent * (len(a) + len(b) - common):
                    root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(least.get(find(i), doc), doc)
    return sorted(
        ((doc, len(sets[i]), least.get(find(i)) if sets[i] else doc) for i, (doc, _) in enumerate(rows)), key=str
    )


def check(spark, rows, width=2, percent=80):
    got = neardup.deduplicate(spark.createDataFrame(rows, SCHEMA), width, percent).collect()
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == brute(rows, width, percent)


def mutated(words, rate, rng):
    return " ".join(f"m{rng.randrange(10**6)}" if rng.random() < rate else w for w in words)


def test_groups_of_all_sizes(spark):
    rng = random.Random(3)
    rows, doc = [], 0
    for size in (1, 1, 2, 2, 3, 5, 9, 20, 60, 150):
        base = [f"w{rng.randrange(2000)}" for _ in range(rng.choice((12, 60, 200)))]
        for _ in range(size):
            rows.append((doc, mutated(base, rng.choice((0, 0.005, 0.02, 0.04)), rng)))
            doc += 1
    rng.shuffle(rows)
    check(spark, rows)
    check(spark, rows[:120], width=5)


def test_star_around_one_text(spark):
    """A dense region where texts are linked with its centre only."""
    rng = random.Random(8)
    base = [f"b{i}" for i in range(400)]
    rows = [(500, " ".join(base))]
    for i in range(120):
        words = list(base)
        for k in rng.sample(range(0, 400, 2), 19):
            words[k] = f"x{i}_{k}"
        rows.append((i, " ".join(words)))
    check(spark, rows)


def test_pairs_inside_a_template_family(spark, monkeypatch):
    """A dense region of unlinked look-alikes (similarity 0.77) that hides many pairs at 0.82."""
    monkeypatch.setattr(neardup, "TILE", 64, raising=False)
    rng = random.Random(5)
    template = [f"t{i}" for i in range(262)]
    rows = []
    for i in range(150):
        own = [f"o{i}_{k}" for k in range(38)]
        rows.append((i, " ".join(template + own)))
        if i % 3 == 0:
            rows.append((1000 + i, " ".join(template + own[:8] + [f"p{i}_{k}" for k in range(30)])))
    rng.shuffle(rows)
    check(spark, rows)


def test_pairs_to_confirm_follow_the_rows_of_a_family(spark, monkeypatch):
    """Look-alikes (similarity 0.77), few of them linked: pairs of a dense region never become rows of a table."""
    confirm, made = neardup.confirm, []

    def counted(pairs, *rest):
        made.append(pairs.count())
        return confirm(pairs, *rest)

    monkeypatch.setattr(neardup, "confirm", counted)
    monkeypatch.setattr(neardup, "TILE", 64)
    monkeypatch.setattr(neardup, "TILE_ITEMS", 20_000)
    rng = random.Random(9)
    template = [f"t{i}" for i in range(130)]
    rows = [(i, " ".join(template + [f"o{i}_{k}" for k in range(19)])) for i in range(400)]
    rows += [(1000 + i, f"{rows[i][1]} x{i} y{i}") for i in range(0, 400, 40)]
    rng.shuffle(rows)
    check(spark, rows)
    assert sum(made) < 60 * len(rows)


def test_edges(spark):
    rows = [
        (1, None), (2, ""), (3, " \n"), (4, "one"), (5, "ONE"), (6, "one two"), (7, "One\ttwo\n"), (None, "one two"),
        (None, "only here"), (8, "É a"), (9, "é a"), (10, "a b " * 3000), (11, "b a " * 3000), (12, "a b"), (12, "a b"), (12, "c d e"),
    ]
    check(spark, rows)
    assert neardup.deduplicate(spark.createDataFrame([], SCHEMA)).count() == 0
    clash = spark.createDataFrame([(1, "a b", 3, "x"), (2, "a b", 4, "y")], SCHEMA + ", n int, v string")
    kept = neardup.distinct(clash)
    assert kept.columns == clash.columns and [r["doc_id"] for r in kept.collect()] == [1]


def test_small_chunks_and_split_regions(spark, monkeypatch):
    """Candidates found across chunks and tasks: few rows a chunk, many partitions."""
    rng = np.random.default_rng(1)
    items = [np.unique(rng.integers(0, 1 << 63, 50, dtype=np.uint64)) for _ in range(5)]
    for i in range(4):
        items[i + 1] = np.unique(np.r_[items[0][: 48 - i], rng.integers(0, 1 << 63, 2 + i, dtype=np.uint64)])
    sigs = [neardup.orders(neardup.signature(x)) for x in items]
    rows = [(v, 50, v, [int(k) for k in s[0]], [int(k) for k in s[1]]) for v, s in enumerate(sigs)]
    classes = spark.createDataFrame(rows, "v bigint, n bigint, l bigint, regions array<bigint>, deeper array<bigint>")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        found = []
        for parts in ("1", "40"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
            found.append({(r["a"], r["b"]) for r in neardup.candidates(classes, 80)[0].collect()})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert found[0] == found[1]


@pytest.mark.parametrize("links", [[], [(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 40)] + [(100, 101), (101, 7)]])
def test_components(spark, links):
    got = {r["v"]: r["label"] for r in neardup.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert set(got) >= {v for pair in links for v in pair if v}
    assert all(label == 0 for label in got.values())


@pytest.mark.parametrize("few", [0, 1000])
def test_components_in_one_task_or_many(spark, monkeypatch, few):
    monkeypatch.setattr(neardup, "FEW_LINKS", few, raising=False)
    rng = random.Random(2)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)]
    root = list(range(300))
    for _ in range(300):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    got = {r["v"]: r["label"] for r in neardup.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {v: root[v] for pair in links for v in pair if root[v] != v}


def test_few_links_are_followed_without_shuffles(spark, monkeypatch):
    """Rounds over a handful of links: no table of a round comes from several tasks."""
    files = []
    take = neardup.Scratch.written

    def counted(self, df, name):
        out = take(self, df, name)
        files.append(len(out.inputFiles()))
        return out

    monkeypatch.setattr(neardup.Scratch, "written", counted)
    links = spark.createDataFrame([(i, i + 1) for i in range(40)], "a bigint, b bigint").repartition(8)
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        assert neardup.components(links).where("label = 0").count() == 40
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert files and max(files) == 1


def test_whole_table_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    got = neardup.deduplicate(docs).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == brute(rows, 2, 80)


def test_distinct_leaves_one_row_of_each_component(spark):
    rows = [
        (1, "a b c d e f", "x"), (1, "a b c d e f", "x"), (1, "a b c d e f", "y"), (2, "A b c d e f", "x"), (3, "other words", "x"), (3, "A B C D E F", "x"),
        (None, "other words", "x"), (None, "alone", "x"), (None, "alone", "y"), (4, "", "x"), (4, None, "x"), (5, " ", "x"), (0, "two texts", "x"), (0, "of one id", "x"),
    ]
    got = neardup.distinct(spark.createDataFrame(rows, SCHEMA + ", label string")).collect()
    assert sorted((r["doc_id"], (r["text"] or "").lower().strip()) for r in got if r["doc_id"] is not None) == [
        (0, "of one id"), (0, "two texts"), (1, "a b c d e f"), (3, "other words"), (4, ""), (5, ""),
    ]
    assert [r["text"] for r in got if r["doc_id"] is None] == ["alone"] and {"doc_id", "text", "label"} == set(got[0].asDict())


def test_links_between_known_components(spark):
    label = spark.createDataFrame([(2, 1), (3, 1), (5, 4)], "v bigint, label bigint")
    links = spark.createDataFrame([(3, 5), (2, 3), (7, 9), (5, 7)], "a bigint, b bigint")
    got = {r["v"]: r["label"] for r in neardup.extended(label, links).collect()}
    assert got == {2: 1, 3: 1, 4: 1, 5: 1, 7: 1, 9: 1}
    inside = spark.createDataFrame([(2, 3), (4, 5)], "a bigint, b bigint")
    assert neardup.extended(label, inside) is label


def test_tables_between_steps_are_deleted(spark, monkeypatch, tmp_path):
    from trawlspark.llm import stage

    monkeypatch.setattr(stage, "work_folder", lambda _, name: str(tmp_path / f"{name}-{uuid.uuid4().hex}"))
    base = [f"w{i}" for i in range(60)]
    rows = [(k, " ".join(base[:k] + ["x"] + base[k:])) for k in range(40)]
    kept = neardup.distinct(spark.createDataFrame(rows, "doc_id bigint, text string"), 2, 80)
    assert [r["doc_id"] for r in kept.collect()] == [0]
    assert [p.name.split("-")[0] for p in tmp_path.iterdir()] == ["kept"]
