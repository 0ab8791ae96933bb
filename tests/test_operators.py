"""Operators that the registered queries do not reach, on small hand-made rows."""

from __future__ import annotations

import base64
import json

import pytest
from pyspark.sql import functions as F

from decklattice.functions import scalars
from decklattice.operators import decks, losses, mods, sampling, store, views
from decklattice.operators import similarity as sim
from decklattice.operators.rates import RateSpec
from decklattice.sources import readers
from decklattice.streaming import counts


def varints(*numbers):
    out = bytearray()
    for n in numbers:
        while n > 127:
            out.append(n & 127 | 128)
            n >>= 7
        out.append(n)
    return base64.b64encode(bytes(out)).decode()


def test_deckstrings(spark):
    code = varints(0, 1, 2, 1, 813, 2, 5, 1004, 1, 77, 1, 300, 3)
    rows = spark.createDataFrame([(code,), ("###",), (None,), ("AAE",)], "c string").select(readers.deckstrings(F.col("c")).alias("d")).collect()
    assert [[(e.card, e.n) for e in r.d] for r in rows] == [[(5, 1), (1004, 1), (77, 2), (300, 3)], [], [], []]


def test_files_and_archives(spark, tmp_path):
    import io
    import tarfile

    (tmp_path / "a.html").write_text('<div data-id="7" data-name="x y">A &amp; B<br>C<script>no</script></div>')
    page = readers.pages(spark, str(tmp_path / "a.html")).select(readers.text_of_html(F.col("html")).alias("t"), readers.data_attributes(F.col("html")).alias("d")).first()
    assert page.t == "A & B\nC" and page.d == {"id": "7", "name": "x y"}
    with tarfile.open(tmp_path / "x.tar", "w") as tar:
        for name in ("one.html", "two.txt"):
            info = tarfile.TarInfo(name)
            info.size = 3
            tar.addfile(info, io.BytesIO(b"abc"))
    for stream in (False, True):
        assert [(r.member, r.text) for r in readers.archive_members(spark, str(tmp_path / "x.tar"), ".html", stream).collect()] == [("one.html", "abc")]
    (tmp_path / "w.csv").write_text("id,deck_Fire Bolt,won\n1,2,true\n2,,false\n")
    assert [tuple(r) for r in readers.wide_csv(spark, str(tmp_path / "w.csv"), "deck_.*").collect()] == [("1", 2, "true"), ("2", None, "false")]
    readers.write_json_shards(spark.range(10).coalesce(1), str(tmp_path / "out"), 4)
    assert len(list((tmp_path / "out").glob("*.gz"))) == 3
    assert readers.json_lines(spark, str(tmp_path / "out"), "id long").count() == 10
    stamped = readers.with_lineage(spark.range(3), {"cards": "v1"})
    stamped.write.parquet(str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).schema["id"].metadata == {"cards": "v1"}
    kept, bad = readers.with_rejects(spark.range(5), F.when(F.col("id") > 2, F.lit("large")))
    assert kept.count() == 3 and {r.reject_reason for r in bad.collect()} == {"large"}


def test_store_rules(spark):
    old = spark.createDataFrame([(1, "a", "xx"), (2, "b", None)], "k int, v string, w string")
    new = spark.createDataFrame([(2, "B", "y"), (3, "C", "z")], "k int, v string, w string")
    out = store.upsert(old, new, ["k"], {"v": store.keep_existing, "w": store.keep_longer})
    assert sorted(tuple(r) for r in out.collect()) == [(1, "a", "xx"), (2, "b", "y"), (3, "C", "z")]
    assert store.delete(old, new, ["k"]).count() == 1
    assert sorted(r.k for r in store.create_if_absent(old, new, ["k"]).collect()) == [1, 2, 3]
    assert {r.k: r.v for r in store.last_file_wins([old, new], ["k"]).collect()} == {1: "a", 2: "B", 3: "C"}
    with pytest.raises(Exception, match="duplicate key"):
        store.insert(old, new, ["k"]).collect()
    merged = spark.range(1).select(store.merge_keys(F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2")), F.create_map(F.lit("b"), F.lit("3"))).alias("m")).first().m
    assert merged == {"a": "1", "b": "3"}


def test_content_mods(spark):
    m = F.create_map(*[F.lit(x) for x in ("cardName", "Bolt", "Type", "", "cost", "0", "copy", "Bolt")])
    r = spark.range(1).select(mods.key_case(m, "snake").alias("snake"), mods.without_noise(m, ["copy"]).alias("clean"), mods.mask_random_key(m, "s", F.col("id")).alias("masked"), mods.mask_key(m, "new").alias("added"), mods.first_of_repeated(m, F.array(*[F.lit(x) for x in ("cardName", "Type", "cost", "copy")])).alias("once"), mods.shuffled_keys(m, "s", F.col("id").cast("string")).alias("order")).first()
    assert set(r.snake) == {"card_name", "type", "cost", "copy"} and r.clean == {"cardName": "Bolt", "cost": "0"}
    assert list(r.masked.values()).count("[MASK]") == 1 and r.added["new"] == "[MASK]" and set(r.once) == {"cardName", "Type", "cost"}
    assert sorted(e.key for e in r.order) == ["Type", "cardName", "copy", "cost"]
    flat = spark.createDataFrame([(json.dumps({"a": {"b": 1, "c": {}}, "d": [1]}),), (None,)], "j string").select(mods.flattened(F.col("j")).alias("f")).collect()
    assert json.loads(flat[0].f) == {"a.b": 1, "a.c": {}, "d": [1]} and flat[1].f is None


def test_deck_mods_and_arrays(spark):
    bags = decks.decks_of(spark.createDataFrame([(d, c) for d in range(20) for c in "aabcdefg"], "d int, c string"), ["d"], "c")
    assert bags.select("deck_uuid").distinct().count() == 1 and decks.distinct_decks(bags).count() == 1
    by_deck = bags.withColumn("deck_uuid", F.col("d").cast("string"))
    assert all(len(r.cards) == 4 for r in decks.subsample(by_deck, "s", 0.5).collect())
    assert all(1 <= len(r.cards) <= 8 for r in decks.dropout(by_deck, "s", 0.99).collect())
    rest = decks.masked_card(by_deck, "m").collect()
    assert all(sorted([*r.rest, r.target_card]) == sorted("aabcdefg") for r in rest)
    x = spark.range(1).select(scalars.chunks(F.array(*[F.lit(c) for c in "abcde"]), 2).alias("c"), scalars.chunks(F.array(F.lit("a")), 2).alias("e"), scalars.expand_copies(F.array(F.struct(F.lit("x").alias("card"), F.lit(2).alias("n")))).alias("x"), scalars.fold_name(F.lit("  Éa’s   –x ")).alias("n")).first()
    assert (x.c, x.e, x.x, x.n) == ([["a", "b"], ["c", "d"]], [], ["x", "x"], "ea's -x")
    s = views.slices(by_deck, "s", 3, 2).collect()
    assert all(len({c for p in r.slices for c in p}) == 6 for r in s)


def test_contrastive_losses(spark):
    pairs = spark.createDataFrame([("a", 1.0, True), ("a", 0.0, False), ("a", 2.0, False), ("b", 0.5, True)], "a string, l double, p boolean")
    import math

    want = math.log(math.exp(1) + math.exp(0) + math.exp(2)) - 1
    out = losses.info_nce(pairs, "a", "l", F.col("p")).first()
    assert out.loss == pytest.approx(want / 2) and out.anchors == 2
    assert losses.constant_logit_loss(pairs, "a", F.col("p")).first().loss == pytest.approx(math.log(3) / 2)
    y = spark.createDataFrame([(float(v),) for v in (1, 2, 3, 4, 100)], "y double")
    assert 0 < losses.huber_baseline(y, F.col("y")) < 1
    with pytest.raises(Exception, match="no spread"):
        losses.label_stats(spark.createDataFrame([(1.0,), (1.0,)], "y double"), F.col("y")).collect()
    v = spark.createDataFrame([([0.0, None], [1.0, 0.5]), ([2.0, 0.0], [None, 1.0])], "z array<double>, y array<double>")
    assert losses.binary_baseline(y, F.col("y") > 2).first().baseline == pytest.approx(-0.6 * math.log(0.6) - 0.4 * math.log(0.4))
    assert v.where("z[1] is not null").agg(losses.masked_vector(F.col("z"), F.col("y"))).first()[0] == pytest.approx(0.25)


def test_sampling(spark):
    assert sampling.positional_splits(11, [8, 1, 1]) == [(0, 8), (8, 9), (9, 11)]
    assert [r.id for r in sampling.sitemap_then_spread(spark.createDataFrame([(0, 3), (1, 1)], "position long, id long"), sampling.spread_order(4, 3, 0, spark)).orderBy("part", "position").collect()] == [3, 1, 4, 2]
    drawn = sampling.weighted_choice(spark.range(4000).withColumnRenamed("id", "k"), spark.createDataFrame([("x", 3.0), ("y", 1.0)], "o string, w double"), "s", "k", "o", "w")
    share = drawn.agg(F.avg((F.col("o") == "x").cast("double"))).first()[0]
    assert share == pytest.approx(0.75, abs=0.03)
    low, high = sim.bootstrap(spark.range(200).withColumn("v", (F.col("id") % 2).cast("double")), "s", "id", "v", 200).first()
    assert low < 0.5 < high and high - low < 0.25


def test_svd_keeps_the_strongest_relations(spark):
    pairs = spark.createDataFrame([(a, b, 3.0 if a[0] == b[0] else 0.1) for a in ("a1", "a2", "b1", "b2") for b in ("a1", "a2", "b1", "b2")], "a string, b string, ppmi double")
    v = {r.card: r.vector for r in sim.svd_vectors(pairs, 2).collect()}
    dot = lambda x, y: abs(sum(p * q for p, q in zip(v[x], v[y])))
    assert set(v) == {"a1", "a2", "b1", "b2"} and dot("a1", "a2") == pytest.approx(3) and dot("a1", "b1") == pytest.approx(0.1)


def test_stream_counts_each_file_once(spark, tmp_path):
    source, sink, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    spec = RateSpec(["card"], F.col("won").cast("int"))
    for rows in ([("x", True), ("x", False)], [("x", True), ("y", False)]):
        spark.createDataFrame(rows, "card string, won boolean").write.mode("append").parquet(source)
        for _ in range(2):
            counts.count_stream(spark, source, "card string, won boolean", spec, sink, state)
    assert {r.card: (round(r.label, 6), r.sample_count) for r in counts.current(spark, sink, spec).collect()} == {"x": (0.666667, 3), "y": (0.0, 1)}


def test_decoys_come_by_weight_and_differ_between_decks(spark):
    from decklattice.operators import sampling

    ranges = sampling.weighted_ranges(spark.createDataFrame([("a", 1.0), ("b", 3.0), ("c", 0.0), ("d", 4.0)], "card string, weight double"), "card", "weight", bins=16).collect()
    width = {r.card: r.hi - r.lo for r in ranges}
    assert width == {"a": 0.125, "b": 0.375, "d": 0.5} and {r.bin for r in ranges} == set(range(16))
    copies = spark.range(400).selectExpr("id AS deck", "explode(array('x', concat('y', id % 40), concat('z', id % 5))) AS card")
    out = sampling.held_out(copies, "s", "deck", "card", 3, 10.0).collect()
    assert len(out) == 400 and all(len(set(r.decoys)) == 3 for r in out) and len({tuple(r.decoys) for r in out}) > 200
    assert all(c not in ("x", f"y{r.deck % 40}", f"z{r.deck % 5}") for r in out for c in r.decoys)
    z = sum(c[0] == "z" for r in out for c in r.decoys) / 1200
    assert 0.4 < z < 0.75  # 4 of 5 cards z with a fifth of the decks each, against 39 of 40 cards y
    again = {r.deck: r.decoys for r in sampling.held_out(copies.repartition(7), "s", "deck", "card", 3, 10.0).collect()}
    assert again == {r.deck: r.decoys for r in out}


def test_decoys_are_drawn_within_the_row_of_a_deck(spark):
    """Blocks of cards change nothing, and no row is made of a draw: these filled the disk."""
    copies = spark.range(300).selectExpr("id AS deck", "explode(array('x', concat('y', id % 40), concat('z', id % 5))) AS card")
    rows = lambda f: sorted((r.deck, r.target, tuple(r.decoys)) for r in f.collect())
    whole = sampling.held_out(copies, "s", "deck", "card", 3, 10.0)
    assert rows(whole) == rows(sampling.held_out(copies, "s", "deck", "card", 3, 10.0, cards=9))
    assert "explode(sequence" not in whole._jdf.queryExecution().toString()
    assert sampling.held_out(copies.where("deck < 0"), "s", "deck", "card", 3, 10.0).count() == 0
