"""Sources, sinks, the whole job, streaming arrivals and the query catalogue."""

from __future__ import annotations

import random
from decimal import Decimal

import duckdb
import pytest

import __spark_entry__
from kindred.operators import blocking, profile
from kindred.options import Budget
from kindred.plans import catalogue, cli, matching, reports
from kindred.sources import tables
from kindred.streaming.arrivals import match_arrivals

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents benchmark labels".split()


def write(path, rows, bom=""):
    path.write_text(bom + "\n".join("\t".join(r) for r in rows) + "\n", encoding="utf-8")
    return str(path)


def test_delimited_sources(spark, tmp_path):
    path = write(tmp_path / "s.tsv", [tables.COLUMNS, ["S1-1", " Acme & Co ", "D-4 Rd 12", "DE"], ["S1-2", "", "", ""]], bom="﻿")
    assert [tuple(r) for r in tables.read_source(spark, path).collect()] == [("S1-1", "Acme & Co", "D-4 Rd 12", "DE"), ("S1-2", "", "", "")]
    cached = tables.load_cached(spark, path, str(tmp_path / "cache"))
    assert cached.where("entity_id = 'S1-1'").first()["name_norm"] == "acme and co" and cached.first() is not None
    assert tables.load_cached(spark, path, str(tmp_path / "cache"), load=False) is None and len(list((tmp_path / "cache").iterdir())) == 1
    bad = write(tmp_path / "bad.tsv", [["id", "x"], ["1", "2"]])
    with pytest.raises(ValueError, match="header"):
        tables.read_source(spark, bad)
    odd = write(tmp_path / "odd.tsv", [tables.COLUMNS, ["a", "b"], ["a", "b", "c", "d"]])
    assert sorted(r["malformed"] for r in tables.read_malformed(spark, odd).collect()) == [False, True]
    truth = write(tmp_path / "t.tsv", [["source1_entity_id", "matched_entity_ids"], ["S1-1", "S2-1, ,S3-1"], ["S1-2", ""], ["S1-1", "S2-9"]])
    assert {r["s1_id"]: r["matched"] for r in tables.read_ground_truth(spark, truth).collect()} == {"S1-1": ["S2-9"], "S1-2": []}


def businesses(n, seed):
    rng = random.Random(seed)
    words = [a + b for a in ("nor", "sud", "ost", "wes", "mit", "hoch") for b in ("wind", "bau", "tec", "hof", "werk", "see")]
    rows = {1: [], 2: [], 3: []}
    truth = []
    for i in range(n):
        name, address, country = " ".join(rng.sample(words, 3)), f"{rng.choice(words)} street {rng.randrange(900)}", rng.choice(["DE", "FR"])
        rows[1].append([f"S1-{i}", name, address, country])
        links = []
        for s in (2, 3):
            if rng.random() < 0.6:
                rows[s].append([f"S{s}-{i}", name if rng.random() < 0.5 else name.replace("nor", "nord"), address, country])
                links.append(f"S{s}-{i}")
            rows[s].append([f"S{s}-x{i}", " ".join(rng.sample(words, 3)), f"{rng.choice(words)} street {rng.randrange(900)}", country])
        truth.append([f"S1-{i}", ",".join(links)])
    return rows, truth


def test_train_and_infer(spark, tmp_path):
    rows, truth = businesses(120, 4)
    paths = [write(tmp_path / f"s{s}.tsv", [tables.COLUMNS, *rows[s]]) for s in (1, 2, 3)]
    gt = write(tmp_path / "gt.tsv", [["source1_entity_id", "matched_entity_ids"], *truth])
    loaded = cli.load(spark, paths, str(tmp_path / "cache"))
    links = tables.read_ground_truth(spark, gt).selectExpr("s1_id", "explode(matched) as candidate_id").join(loaded.selectExpr("entity_id as candidate_id", "source"), "candidate_id")
    trained = matching.train(loaded, links, str(tmp_path / "train"), boosting={"rounds": 3})
    assert trained.scores[trained.name] > 0.8 and trained.recall["recall"] > 0.9 and "threshold" in matching.report(trained)
    matching.save(trained, str(tmp_path / "model"))
    assert matching.is_saved(spark, str(tmp_path / "model")) and not matching.is_saved(spark, str(tmp_path / "none"))
    again = matching.load(spark, str(tmp_path / "model"))
    assert (again.name, again.threshold, again.scores) == (trained.name, trained.threshold, trained.scores)
    if trained.model is not None:
        written = spark.read.option("header", True).csv(str(tmp_path / "model/importances")).collect()
        assert len(written) == 41 and [float(r["importance"]) for r in written] == sorted((float(r["importance"]) for r in written), reverse=True)
    found, _ = matching.infer(loaded, again, str(tmp_path / "test"))
    assert found.count() == 120
    want = dict(truth)
    right = sum(r["matched_entity_ids"] == ",".join(sorted(filter(None, want[r["source1_entity_id"]].split(",")))) for r in found.collect())
    assert right > 90
    written = spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "test/matching"))
    assert written.columns == ["source1_entity_id", "matched_entity_ids"] and written.count() == 120


def test_choices_and_caches(spark, tmp_path):
    rows, truth = businesses(30, 5)
    paths = [write(tmp_path / f"s{s}.tsv", [tables.COLUMNS, *rows[s]]) for s in (1, 2, 3)]
    loaded = cli.load(spark, paths, str(tmp_path / "cache"))
    few = cli.chosen(loaded, source=3, limit=7)
    assert few.where("source = 1").count() == 7 and few.where("source = 2").count() == 0 and few.where("source = 3").count() == len(rows[3])
    assert [r["entity_id"] for r in few.where("source = 1").orderBy("entity_id").collect()] == sorted(r[0] for r in rows[1])[:7]
    gt = write(tmp_path / "gt.tsv", [["source1_entity_id", "matched_entity_ids"], *truth])
    for _ in range(2):
        assert tables.load_cached_truth(spark, gt, str(tmp_path / "cache")).count() == 30
    targets = loaded.where("source > 1")
    made = [tables.load_cached_postings(targets, str(tmp_path / "cache"), "t", Budget(max_token_df=n)).count() for n in (1, 100, 100)]
    assert made[0] < made[1] == made[2] and len(list((tmp_path / "cache").glob("postings-*"))) == 2
    queries = loaded.where("source = 1")
    listed = tables.load_cached_postings(targets, str(tmp_path / "cache"), "t", Budget(max_token_df=100))
    plain, prepared = (sorted(map(tuple, blocking.retrieve(queries, targets, Budget(max_token_df=100, per_s1=4), x).collect())) for x in (None, listed))
    assert plain == prepared
    a = cli.arguments(["retrieve", "--sources", *paths, "--out", "o", "--limit", "3", "--source", "2", "--split", "test", "--force", "--fast"])
    assert (a.limit, a.source, a.split, a.force, a.fast) == (3, 2, "test", True, True)


def test_arrivals(spark, tmp_path):
    rows, _ = businesses(20, 9)
    paths = [write(tmp_path / f"s{s}.tsv", [tables.COLUMNS, *rows[s]]) for s in (1, 2, 3)]
    loaded = cli.load(spark, paths, str(tmp_path / "cache"))
    loaded.where("source = 1").write.parquet(str(tmp_path / "in"))
    targets = loaded.where("source > 1")
    stream = spark.readStream.schema(loaded.schema).parquet(str(tmp_path / "in"))
    match_arrivals(stream, targets, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    exact = blocking.exact_channel(loaded.where("source = 1"), targets, 1, 100)
    assert got.count() > 0 and exact.join(got, ["s1_id", "candidate_id"], "left_anti").count() == 0


def plain(rows, columns):
    def cell(v):
        return None if v is None or v != v else round(float(v), 5) if isinstance(v, (float, Decimal)) else str(v)

    return sorted((tuple(cell(r[c]) for c in sorted(columns)) for r in rows), key=str)


@pytest.fixture(scope="module")
def engine():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_equals_its_sql(spark, engine, name):
    got = catalogue.QUERIES[name](spark, SF)
    found = engine.execute(catalogue.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    want = [dict(zip(names, r, strict=True)) for r in found.fetchall()]
    assert sorted(got.columns) == sorted(names)
    assert plain([r.asDict() for r in got.collect()], got.columns) == plain(want, got.columns)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL) - {"ml_lr", "ml_gbt"}))
def test_other_queries_run(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0


def test_reports(spark):
    rows = catalogue.entities(spark, SF, "part")
    parts = {"columns": profile.columns(rows), "none": rows.limit(0)}
    text = reports.as_markdown("Profile", parts)
    assert "and 7 more rows" in str(reports.collected({"columns": profile.columns(rows)}, shown=2))
    assert text.startswith("# Profile") and "| source | field |" in text and "No rows." in text and '"n_rows"' in reports.as_json(parts)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
