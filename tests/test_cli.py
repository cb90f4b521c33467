from foliospark import cli
from tests.test_pdf import PAGE, make


def test_parse_markdown_and_check(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.pdf").write_bytes(make([PAGE]))
    out = str(tmp_path / "out")
    assert cli.main(["markdown", str(tmp_path / "in"), out]) == 0
    assert "Hello (PDF)" in spark.read.parquet(f"{out}/markdown").first().markdown
    assert cli.main(["markdown", str(tmp_path / "in"), out]) == 1
    assert cli.main(["parse", str(tmp_path / "in"), out, "--replace"]) == 0
    assert spark.read.parquet(f"{out}/elements").count() == 4
    assert cli.main(["check", str(tmp_path / "in")]) == 0
    assert cli.main(["parse", str(tmp_path / "in")]) == 2
