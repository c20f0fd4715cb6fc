"""Crawls in rounds, and work that goes on where it was cut off."""

import os
import random

import pytest
from pyspark.sql import functions as F

from prospecta.operators.crawl import crawl, rounds_done
from prospecta.sources import progress


def breadth_first(seeds, graph, most):
    """Round by round; a page's links belong to its seed, a link to the first seed of its round."""
    order = {}
    for n, url in seeds:
        order[url] = min(n, order.get(url, n))
    held = {url: (n, url, 0) for url, n in order.items()}
    for k in range(1, most + 1):
        new = {}
        for url, (n, seed, at) in held.items():
            if at == k - 1:
                for target in graph.get(url, ()):
                    if target not in held and (target not in new or n < new[target][0]):
                        new[target] = (n, seed, k)
        held |= new
    return held


def links_of(df):
    return df.select("url", F.explode(F.split("html", " ")).alias("profile_url")).filter("profile_url <> ''").distinct()


@pytest.mark.parametrize("seed", [1, 2])
def test_rounds_equal_a_breadth_first_search(spark, tmp_path, seed):
    draw = random.Random(seed)
    graph = {f"p{i}": [f"p{draw.randrange(90)}" for _ in range(draw.choice([0, 1, 2, 6]))] for i in range(70)}
    pages = spark.createDataFrame([(u, " ".join(t)) for u, t in graph.items()], "url string, html string")
    seeds = [(0, "p3"), (1, "p40"), (2, "p3"), (3, "p999")]
    path = str(tmp_path / "crawl")
    crawl(spark.createDataFrame(seeds, "seed_ord long, url string"), pages, links_of, path, 1)  # cut off after a round
    held = {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names}
    got = crawl(spark.createDataFrame(seeds, "seed_ord long, url string"), pages, links_of, path)
    want = breadth_first(seeds, graph, 10)
    assert {r.url: (r.seed_ord, r.seed_url, r["round"]) for r in got.collect()} == want and got.count() == len(want) and max(v[2] for v in want.values()) >= 3
    assert all(os.stat(f).st_mtime_ns == t for f, t in held.items()) and rounds_done(spark, path) == max(v[2] for v in want.values()) + 1


def test_a_restarted_run_does_the_rest(spark, tmp_path):
    rows = [(i, f"u{i % 9}", i * i) for i in range(200)]
    work = spark.createDataFrame(rows, "id int, unit string, x int")
    made, path, jobs = lambda df: df.select("id", (F.col("x") + 1).alias("y"), "unit"), str(tmp_path / "out"), []

    def breaks(df):
        jobs.append(1)
        if len(jobs) == 3:
            raise RuntimeError("cut off")
        return made(df)

    with pytest.raises(RuntimeError):
        progress.run(work, "unit", path, breaks, 5)
    done = {r.unit for r in progress.finished(spark, path).collect()}
    assert 0 < len(done) < 9
    stamp = lambda: {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(f"{path}/data") for f in names if d.rsplit("=", 1)[-1] in done}
    before = stamp()
    assert progress.run(work, "unit", path, made, 5) == 9 - len(done) and stamp() == before
    got = sorted(map(tuple, progress.output(spark, path, made(work).schema).collect()))
    assert got == sorted((i, x + 1, u) for i, u, x in rows) and progress.run(work, "unit", path, made, 5) == 0
    assert {r.unit: r["rows"] for r in progress.finished(spark, path).collect()} == {f"u{k}": sum(i % 9 == k for i in range(200)) for k in range(9)}
