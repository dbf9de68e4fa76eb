"""How many files line deduplication makes; each costs a process on Hadoop's local file system."""

from pathlib import Path

from bytelake.llm import linededup
from bytelake.llm.shared import partitions


def test_runs_have_no_more_buckets_than_their_lines_are_worth(spark, monkeypatch):
    files, write, own = [], linededup.LineRuns._write, partitions(spark)

    def counted(self, rows):
        name = write(self, rows)
        files.append(len(list(Path(f"{self.path.removeprefix('file://')}/{name}").glob("part-*"))))
        return name

    monkeypatch.setattr(linededup.LineRuns, "_write", counted)
    line = "line %06d that is long enough to be looked at"
    texts = ["\n".join(line % (i if n % 2 else 40 * d + i) for n, i in enumerate(range(40))) for d in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        got = {r["doc_id"]: r["text"] for r in linededup.dedup_lines(docs).collect()}
        assert partitions(spark) == 200
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", str(own))
    holders = {}
    for d, text in enumerate(texts):
        for x in text.split("\n"):
            holders.setdefault(x, set()).add(d)
    gone = {x: max(h) for x, h in holders.items() if len(h) >= 5}
    assert got == {d: "\n".join(x for x in t.split("\n") if gone.get(x, d) == d) for d, t in enumerate(texts)}
    assert files and max(files) <= 2 * spark.sparkContext.defaultParallelism


def test_large_inputs_have_all_the_partitions_of_the_session(spark):
    own = partitions(spark)
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        with linededup.buckets_for(spark, 2_500_000) as n:
            assert n == 50 == partitions(spark)
        with linededup.buckets_for(spark, 10**9) as n:
            assert n == 200
        assert partitions(spark) == 200
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", str(own))
