"""Caps per contributor, history deduplication and packing against brute force."""

import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from gleanery.llm import contributor_cap as C
from gleanery.llm import history_dedup as H
from gleanery.llm import packing as P


# --- caps


def brute(rows, cap):
    groups = defaultdict(list)
    for seq, g, s in rows:
        if g is not None:
            groups[g].append((-(s if s is not None else -(10**9)), seq))
    return {seq for v in groups.values() for _, seq in sorted(v)[cap:]}


def test_cap_against_brute_force(spark):
    rng = random.Random(7)
    rows = [(i, rng.choice(["hot", "hot", "hot", "b", "c", None]), rng.choice([None, 1, 5, 5, 5, -3, 100])) for i in range(3_000)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "log_seq long, src string, score int, v string")
    for cap in (0, 1, 12, 5_000):
        got = {r.log_seq for r in C.cap_dropped(df, [F.col("src")], "score", "log_seq", cap=cap).collect()}
        assert got == brute(rows, cap), cap
    got = {r.log_seq for r in C.cap_dropped(df, [F.col("src")], "score", "log_seq", share=0.25).collect()}
    sizes = Counter(r[1] for r in rows if r[1])
    kept = Counter(r[1] for r in rows if r[1] and r[0] not in got)
    assert kept == {k: n // 4 for k, n in sizes.items()}


def test_cap_all_tied_and_empty(spark):
    df = spark.range(5_000).select(F.col("id").alias("log_seq"), F.lit("a").alias("src"), F.lit(None).cast("int").alias("score"))
    got = sorted(r.log_seq for r in C.cap_dropped(df, [F.col("src")], "score", "log_seq", cap=12).collect())
    assert got == list(range(12, 5_000))
    assert C.cap_dropped(df.limit(0), [F.col("src")], "score", "log_seq", cap=12).count() == 0


def test_sources_by_name(spark):
    rows = [(i, 1, s, 9) for i, s in enumerate(["A ", "a", "\ta", None, "", "b"])]
    df = spark.createDataFrame(rows, "log_seq long, batch_no long, source string, score int")
    assert [r.log_seq for r in C.dominant_sources_dropped(df, 2).collect()] == [2]


# --- history


def test_distance_is_a_metric():
    rng = random.Random(1)
    bag = lambda: sorted(H.fact_number(f) for f in rng.choices(["10", "20gb", "=name", "pro"], k=rng.randint(0, 3)))
    points = [(bag(), "".join(sorted(rng.choices("abcd", k=rng.randint(0, 5))))) for _ in range(40)]
    for a in points:
        for b in points:
            assert H.distance(a, b) == H.distance(b, a) and (H.distance(a, b) == 0) == (a == b)
            # what pruning rests on
            assert all(abs(x - y) <= H.distance(a, b) for x, y in zip(H.pivot_distances(a), H.pivot_distances(b)))
            c = points[rng.randrange(40)]
            assert H.distance(a, b) <= H.distance(a, c) + H.distance(c, b)


def test_each_pivot_prunes():
    """Points whose first distances lie close are told apart by the others, before any is verified."""
    points = [([], "".join(sorted(w))) for w in ("abcdefgh" * 8, "acegikmo" * 8, "bdfhjlnp" * 8, "ababcdcd" * 8)]
    d = [H.pivot_distances(p) for p in points]
    assert len({x[0] for x in d}) == 1
    for i in range(len(d)):
        for j in range(i):
            assert (max(abs(x - y) for x, y in zip(d[i], d[j])) > H.RADIUS) <= (H.distance(points[i], points[j]) > H.RADIUS)
    assert any(abs(x - y) > H.RADIUS for x, y in zip(d[1], d[2]))


TITLES = [
    (1, "Free Vofebezi-flash preview at Negurjuge AI — £20", "https://a.example/p/1"),
    (2, "[Deal] free vofebezi-flash trial at Negurjuge AI - £20 (works)", "https://b.example/2"),  # label, synonym, aside
    (3, "Free Vofebezi-flash preview at Negurjuge AI — £25", "https://c.example/3"),  # another amount
    (4, "Free Vofebezi-flash-nano preview at Negurjuge AI — £20", "https://d.example/4"),  # another variant
    (5, "Free Vofebezi-flash preivew at Negurjuge AI — £20", "https://e.example/5"),  # slip
    (6, "Something else altogether", "http://www.a.example/p/1/?utm_source=x#top"),  # the same page
    (7, "Free Vofebezi-flash preview at Negurjuge AI — €20", "https://f.example/7"),  # another unit
    (8, None, None),
    (9, "  ", ""),
    (10, "Free Vofebezi-flash preview at Negurjuge AI — £20 (round 2)", "https://g.example/10"),  # another edition
    (11, "Free Vofebezi-flash preview at Negurjuge AI — £20", "https://h.example/11"),  # an exact copy
]


def fillers():
    return [(100 + i, f"Free Product{chr(97 + i % 26)}{chr(97 + i // 26)}xyz preview at Negurjuge AI — £{i} trial free", f"https://x.example/{i}") for i in range(60)]


def test_announcements(spark):
    df = spark.createDataFrame([(*r, "x") for r in TITLES + fillers()], "log_seq long, title string, url string, id string")
    got = {tuple(r) for r in H.announcements(df).collect()}
    assert got == {(1, 2), (1, 5), (1, 6), (1, 11)}
    assert H.announcements(df.limit(0)).count() == 0


def in_parts(df, folder, bounds):
    words = H.learn_words(H.folded_titles(df, "log_seq", "title"))
    for n, (lo, hi) in enumerate(bounds):
        history = H.History(df.sparkSession, folder, words)  # opened anew for every batch
        batch = df.where((F.col("log_seq") > lo) & (F.col("log_seq") <= hi))
        history.accept(batch, n)
    history.accept(batch, n)  # a batch that is repeated changes nothing
    return {(r["first"], r.id) for r in history.ties().collect()}


def test_batches_give_what_bulk_gives(spark, tmp_path):
    df = spark.createDataFrame(TITLES + fillers(), "log_seq long, title string, url string")
    bulk = {(r.log_seq_a, r.log_seq_b) for r in H.announcements(df).collect()}
    assert in_parts(df, f"file://{tmp_path}/history", ((0, 3), (3, 8), (8, 1_000))) == bulk


CHAIN = [
    (1001, "Free Vofebezi-flash preview at Negurjuge AI — £20", "https://a.example/1"),
    (1002, "Free Vofebezi-flash preview at Negurjuge AI — £20", "https://b.example/2"),  # the title of 1001
    (1003, "Quite another wording of it all", "https://b.example/2"),  # the page of 1002
    (1004, "Free Tagobuli-pro preview at Negurjuge AI — £70", "https://c.example/3"),
    (1005, "Free Tagobuli-pro preview at Negurjuge AI — £70", "https://a.example/1"),  # ties 1004 to 1001
    (1006, None, "https://c.example/3"),
]


def test_chains_through_older_rows(spark, tmp_path):
    """A row tied to an older one through a third, and older announcements that a later row shows to be one."""
    df = spark.createDataFrame(CHAIN + fillers(), "log_seq long, title string, url string")
    want = {(1001, n) for n in range(1002, 1007)}
    assert {(r.log_seq_a, r.log_seq_b) for r in H.announcements(df).collect()} == want
    bounds = [(0, 1001), *((n, n + 1) for n in range(1001, 1006))]
    assert in_parts(df, f"{tmp_path}/history", bounds) == want


def test_incremental_equals_bulk_on_tables(spark, sf):
    from gleanery.llm import catalog

    assert {tuple(r) for r in catalog.p5_incremental(spark, sf).collect()} == {tuple(r) for r in catalog.p5_found(spark, sf).collect()}


def test_hot_announcement(spark):
    """Many wordings of one announcement meet one leader, by a join; a far wording leads beside it."""
    rows = [(i, f"Free Vofebezi-flash preview at Negurjuge AI — £20 {'see it and hear ' * (i % 2)}{chr(97 + i % 26)}", None) for i in range(400)]
    rows.append((900, "Free Vofebezi-flash " + "words of another kind entirely " * 4 + "£20", None))  # far from all
    df = spark.createDataFrame(rows + [(i + 1_000, *r) for i, *r in fillers()], "log_seq long, title string, url string")
    assert {(r.log_seq_a, r.log_seq_b) for r in H.announcements(df).collect()} == {(0, i) for i in range(1, 400)}


def test_components(spark):
    edges = [(i, f"c{i // 2}") for i in range(10)] + [(i, f"d{(i + 1) // 2}") for i in range(10)]  # a chain
    got = {(r.id, r["first"]) for r in H.components(spark.createDataFrame(edges, "id long, cls string")).collect()}
    assert got == {(i, 0) for i in range(10)}


# --- packing


def test_fill_is_whole_and_tight():
    rng = random.Random(3)
    items = [(i, rng.choice("abc"), rng.choice([0, 3, 50, 120, 700, 2_600])) for i in range(900)]
    out = P.fill(items, 512, {"a": 0.5, "b": 0.3, "c": 0.2}, {})
    loads, placed = Counter(), defaultdict(list)
    for id_, piece, window, size in out:
        loads[window] += size
        placed[id_].append((piece, size))
    assert max(loads.values()) <= 512
    for id_, _, size in items:
        pieces = sorted(placed[id_])
        assert sum(s for _, s in pieces) == size and [p for p, _ in pieces] == list(range(len(pieces)))
        assert len(pieces) == (1 if size <= 512 else -(-size // 512))  # split only beyond the capacity
    assert sum(loads.values()) / (512 * len(loads)) > 0.9


def test_deficits_hold_the_mixture():
    items = [(i, "a" if i % 4 else "b", 10) for i in range(4_000)]
    out = P.fill(items, 100, {"a": 0.75, "b": 0.25}, {})
    source = {i: s for i, s, _ in items}
    early = Counter(source[i] for i, _, window, _ in out if window < 200)
    assert abs(early["b"] / sum(early.values()) - 0.25) < 0.01


def test_pack_tables(spark):
    rows = [(i, "some words of a text " * (i % 40), "A" if i % 3 else None, "x") for i in range(200)] + [(500, None, "A", "x"), (501, "long " * 5_000, "A", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, task string")
    kinds = spark.createDataFrame([("short", 512), ("long", 8192), (None, 5)], "container string, capacity_tokens int")
    packed = P.pack(docs, kinds, tokens_per_task=4_000).cache()
    for kind, cap in (("short", 512), ("long", 8192)):
        own = packed.where(F.col("container") == kind)
        assert own.groupBy("bin").agg(F.sum("tokens").alias("t")).where(F.col("t") > cap).count() == 0
        assert own.select("doc_id").distinct().count() == 201
    assert P.fill_report(packed, kinds).count() == 2
    assert P.pack(docs.limit(0), kinds).count() == 0 and P.pack(docs, kinds.limit(0)).count() == 0


# --- all operators


def test_nulls_clashing_columns_and_empty_tables(spark, sf, tmp_path):
    """Rows that are null in every column change no result, further columns neither, and empty tables give empty ones."""
    from gleanery.llm import catalog

    clashing = "pk cls look raw task capacity state h cell led first w n p id2 folded rec restored chain snap part".split()
    for t in ("deals", "hn_hits", "html_segments", "documents", "eval_items", "container_sizes"):
        df = spark.read.parquet(f"{sf}/{t}.parquet")
        nulls = spark.range(3).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema])
        df.unionByName(nulls).withColumns({c: F.lit("x") for c in clashing if c not in df.columns}).coalesce(1).write.parquet(f"{tmp_path}/nulls/{t}.parquet")
        df.limit(0).coalesce(1).write.parquet(f"{tmp_path}/empty/{t}.parquet")
    for name in ("p1_found", "p1_members", "p2_found", "p3_found", "p5_found", "p7_found", "p8_pack", "p9_found", "p10_found"):
        run = catalog.QUERIES[name]
        assert {tuple(r) for r in run(spark, f"{tmp_path}/nulls").collect()} == {tuple(r) for r in run(spark, sf).collect()}, name
        assert run(spark, f"{tmp_path}/empty").count() == 0, name


def test_deficits_before_each_task(spark):
    """Running sums over blocks of tasks against a loop."""
    rng = random.Random(9)
    rows = [(t, s, rng.randint(1, 9)) for t in range(40) for s in "abc" if rng.random() < 0.8]
    shares = {"a": 0.5, "b": 0.3, "c": 0.2}
    old, P.BLOCK = P.BLOCK, 7
    try:
        got = P.starting_deficits(spark.createDataFrame(rows, "task int, source string, n long"), spark.createDataFrame(list(shares.items()), "source string, share double")).collect()
    finally:
        P.BLOCK = old
    for r in got:
        before = [x for x in rows if x[0] < r.task]
        want = shares[r.source] * sum(n for *_, n in before) - sum(n for _, s, n in before if s == r.source)
        assert abs(r.owed - want) < 1e-9


def test_mixture_report(spark):
    packed = spark.createDataFrame([("c", 0, 1, 0, 10), ("c", 0, 2, 0, 10), ("c", 1, 3, 0, 20)], "container string, bin long, doc_id long, piece int, tokens int")
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "doc_id long, source string")
    got = {r.stretch: r.deviation for r in P.mixture_report(packed, docs).collect()}
    assert got == {1: 0.25, 10: 0.0, 100: 0.0}  # shares 3/4 and 1/4; the windows have 1/2 and 1
