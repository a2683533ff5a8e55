"""Output paths by rounds against taking turns."""

import random

from quire.operators import batch as B


def turns(jobs):
    used, out = set(), {}
    for order, path in sorted(jobs):
        head, _, last = path.rpartition("/")
        stem = last.rpartition(".")[0] or last
        stem = f"{head}/{stem}" if head else stem
        now, n = f"{stem}.epub", 2
        while now.lower() in used:
            now, n = f"{stem}-{n}.epub", n + 1
        used.add(now.lower())
        out[order] = now
    return out


def found(spark, jobs):
    got = B.unique_paths(spark.createDataFrame(jobs, "input_order int, path string")).collect()
    assert len(got) == len(jobs)
    return {r.input_order: r.output_path for r in got}


def test_same_as_taking_turns(spark):
    for seed in range(4):
        rng = random.Random(seed)
        name = lambda: rng.choice(["Book", "book", "BOOK", "a"]) + rng.choice(["", "", "-2", "-3", "-2-2", "-10", "-02"]) + rng.choice([".pdf", ".cbz", ".PDF"])  # noqa: E731, B023
        jobs = [(i, rng.choice(["", "x/", "X/y/"]) + name()) for i in rng.sample(range(1000), 150)]
        assert found(spark, jobs) == turns(jobs)


def test_runs_of_taken_numbers(spark):
    """Many numbers held before, and others that come after: few rounds."""
    before = [(i, f"d/b-{i + 2}.pdf") for i in range(300)]
    jobs = [*before, (400, "d/b.pdf"), (401, "d/B.cbz"), (402, "d/b.CBZ"), (403, "d/b-303.cbz"), (404, "d/b-302.pdf"), (405, "d/b.Pdf")]
    assert found(spark, jobs) == turns(jobs)


def test_no_collisions(spark):
    assert found(spark, [(1, "a.pdf"), (2, "b/a.pdf"), (3, "a-2.pdf")]) == {1: "a.epub", 2: "b/a.epub", 3: "a-2.epub"}
    assert found(spark, []) == {}
