"""The jobs on copies of the smallest tables."""

import json
import pathlib
import subprocess
import sys

import duckdb
import pytest

from jobs import panel_report, queries, site_catalogue

DIR = "/root/testdata/sf0.001"
HERE = pathlib.Path(__file__).resolve().parents[1]
TARGETS = f"{DIR}/benchmark.parquet"


def config(name: str) -> str:
    return str(HERE / f"jobs/{name}.json")


def clean(rows) -> list[str]:
    return sorted(str(tuple(round(v, 6) if isinstance(v, float) else v for v in r)) for r in rows)


@pytest.fixture(scope="module")
def contigs(spark):
    """The contigs in three parts, and all sites in them."""
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    return [docs.where(f"doc_id % 3 = {i}").coalesce(1) for i in range(3)]


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_against_sql(spark, name):
    c = duckdb.connect()
    for p in pathlib.Path(DIR).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    settings = lambda: sorted(tuple(r) for r in spark.sql("SET").collect() if r["key"].startswith("spark.sql"))
    before = settings()
    got = queries.queries()[name](spark, DIR)
    want = c.execute(f"SELECT {', '.join(f'"{x}"' for x in got.columns)} FROM ({queries.oracle_sql()[name]})").fetchall()
    assert clean(want) == clean(got.collect())
    assert before == settings()


def test_catalogue_takes_only_what_is_new(spark, contigs, tmp_path):
    into, out = f"{tmp_path}/in", f"{tmp_path}/out"
    run = lambda: site_catalogue.run(spark, into, TARGETS, out, config("site_catalogue"))
    contigs[0].write.parquet(into)
    first = run()
    rows = clean(site_catalogue.written(spark, out).collect())
    assert first["contigs"] == contigs[0].count() and first["sites"] == len(rows) > 0
    files = {p: p.stat().st_mtime_ns for p in pathlib.Path(f"{out}/sites").rglob("part-*")}
    assert run() == {"batches": 0, "contigs": 0, "sites": 0}
    for part in contigs[1:]:
        part.write.mode("append").parquet(into)
    second = run()
    assert second["contigs"] == contigs[1].count() + contigs[2].count()
    grown = clean(site_catalogue.written(spark, out).collect())
    assert first["sites"] + second["sites"] == len(grown) and set(rows) <= set(grown)
    assert all(p.stat().st_mtime_ns == t for p, t in files.items())
    whole = site_catalogue.run(spark, f"{DIR}/documents.parque[t]", TARGETS, f"{tmp_path}/whole", config("site_catalogue"))
    assert whole["sites"] == len(grown) and clean(site_catalogue.written(spark, f"{tmp_path}/whole").collect()) == grown


def test_catalogue_in_small_batches(spark, contigs, tmp_path):
    into, settings = f"{tmp_path}/in", json.loads(pathlib.Path(config("site_catalogue")).read_text()) | {"files_per_batch": 1}
    (tmp_path / "c.json").write_text(json.dumps(settings))
    for part in contigs:
        part.write.mode("append").parquet(into)
    numbers = site_catalogue.run(spark, into, TARGETS, f"{tmp_path}/out", f"{tmp_path}/c.json")
    assert numbers["batches"] == 3 and numbers["sites"] == site_catalogue.written(spark, f"{tmp_path}/out").count()


def test_catalogue_refuses_another_panel_or_a_lost_checkpoint(spark, contigs, tmp_path):
    into, out = f"{tmp_path}/in", f"{tmp_path}/out"
    contigs[0].limit(5).write.parquet(into)
    site_catalogue.run(spark, into, TARGETS, out, config("site_catalogue"), f"{tmp_path}/mark")
    with pytest.raises(ValueError, match="another checkpoint"):
        site_catalogue.run(spark, into, TARGETS, out, config("site_catalogue"))
    spark.read.parquet(TARGETS).limit(3).write.parquet(f"{tmp_path}/few")
    with pytest.raises(ValueError, match="another panel"):
        site_catalogue.run(spark, into, f"{tmp_path}/few", out, config("site_catalogue"), f"{tmp_path}/mark")


def test_report_replaces_the_haplotypes_that_it_reads(spark, contigs, tmp_path):
    out = f"{tmp_path}/out"
    run = lambda path: panel_report.run(spark, path, TARGETS, out, config("panel_report"))
    numbers = run(f"{DIR}/documents.parquet")
    rows = panel_report.written(spark, out)
    first = clean(rows.collect())
    assert numbers["rows"] == len(first) == 8 * numbers["pairs"]
    spark.read.parquet(f"{DIR}/documents.parquet").where("doc_id % 8 = 2 AND doc_id < 100").write.parquet(f"{tmp_path}/some")
    assert run(f"{tmp_path}/some")["rows"] == numbers["pairs"]
    others = clean(panel_report.written(spark, out).where("haplotype <> 2").collect())
    assert others == [r for r in first if not r.endswith(", 2)")]
    run(f"{DIR}/documents.parquet")
    assert clean(panel_report.written(spark, out).collect()) == first


def test_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/none")
    assert panel_report.run(spark, f"{tmp_path}/none", TARGETS, f"{tmp_path}/out", config("panel_report"))["rows"] == 0


def test_command_line(tmp_path, spark, contigs):
    contigs[0].limit(4).write.parquet(f"{tmp_path}/in")
    options = {"contigs": f"{tmp_path}/in", "targets": TARGETS, "out": f"{tmp_path}/out", "config": config("site_catalogue")}
    done = subprocess.run([sys.executable, "-m", "jobs.site_catalogue", *[x for k, v in options.items() for x in (f"--{k}", v)]], cwd=HERE, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert "4 new contigs in 1 batches" in done.stderr and "sites by haplotype" in done.stderr
