"""Files that arrive are told as in a batch."""

import pytest

from phenospark.plans import jobs, panel
from phenospark.streaming import scoring
from synthetic import synthetic

HEAD = "Name\tElement symbol\tType\tSubtype\tClass\tSubclass\n"


@pytest.fixture(scope="module")
def fitted(spark, tmp_path_factory):
    kept = str(tmp_path_factory.mktemp("panel"))
    panel.fit(synthetic(spark, 200, 20), [0]).save(kept)
    return panel.Panel.load(spark, kept)


def _line(symbol):
    return f"x\t{symbol}\tAMR\tAMR\tB\tB1\n"


def test_stream_equals_batch(spark, fitted, tmp_path):
    """Two runs over one folder, a restart between them: every file is told once, an empty one and one of a header too."""
    came, out, at = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "checkpoint")
    came.mkdir()

    def put(name, text):
        (came / f"{name}.amrfinder.tsv").write_text(text)

    def run():
        scoring.follow(spark, fitted, str(came), out, at).awaitTermination()
        scoring.empty(spark, fitted, str(came), out)

    put("562.1", HEAD + _line("blaTEM-1") + _line("sul1"))
    put("562 2+a%", HEAD)
    run()
    put("562.3", HEAD + _line("qnrX") + _line("qnrX"))
    put("562.4", "")
    run()
    told = spark.read.parquet(out)
    batch = jobs.analyze(spark, fitted, str(came))[1]
    rows = lambda df: sorted(map(str, df.select(*batch.columns).collect()))
    assert {r.batch for r in told.select("batch").distinct().collect()} == {-1, 0, 1}
    assert rows(told) == rows(batch) and told.count() == 8


def test_wrong_header_ends_the_stream(spark, fitted, tmp_path):
    came = tmp_path / "in"
    came.mkdir()
    (came / "1.amrfinder.tsv").write_text("Name\tWrong\nx\ty\n")
    with pytest.raises(Exception, match="none of"):
        scoring.follow(spark, fitted, str(came), str(tmp_path / "out"), str(tmp_path / "checkpoint")).awaitTermination()
