import pytest

from readloom import cli
from readloom.plans.encode_events import events_laid_out

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def path(spark):
    return events_laid_out(spark, SF)


def said(spark, capsys, *arguments):
    assert cli.main([str(a) for a in arguments], spark) == 0
    return capsys.readouterr().out


def test_commands(spark, capsys, path, tmp_path):
    out = said(spark, capsys, "check-bam", path, "-l", 1)
    assert "\n1000 reads\n" in out and "false positives, 0 false negatives" in out and "FP" in out and "…" in out
    records = said(spark, capsys, "index-records", path).strip()
    assert "All calls matched!" in said(spark, capsys, "check-bam", path, "-t", records)
    assert said(spark, capsys, "index-blocks", path).strip() == path + ".blocks"
    assert "First read-position matched in 3 BGZF blocks" in said(spark, capsys, "check-blocks", path)
    out = said(spark, capsys, "compute-splits", path, "-m", "50k", "-p")
    assert "2 splits:\n\t340:0\t" in out and "Records of splits:\n\t2\t" in out
    assert "strict\t1000\t-\t2" in said(spark, capsys, "count-reads", path, "-n", 2)
    assert "0 first records of one checker only:" in said(spark, capsys, "time-load", path, "-m", "50k")
    assert "All failing checks: (first 3 of 19):\n\t" in said(spark, capsys, "full-check", path, "-r", "0-100", "-l", 3)


def test_lists_and_files(spark, capsys, path, tmp_path):
    (tmp_path / "list").write_text(f"nothing.bam\n\n{path}\n")
    out = said(spark, capsys, "compare-splits", tmp_path / "list", "-r", "1", "-m", "50k")
    assert "1 files: path" in out and f"\n\t{path}\t2\t2\t0\t0\t" in out and "0 differing splits:" in out
    to = tmp_path / "new.bam"
    assert f"written to {tmp_path / 'text'}" in said(spark, capsys, "rewrite", path, to, "-r", "10-20", "-b", "-i", "-o", tmp_path / "text")
    assert (tmp_path / "text").read_text().split() == [str(to), f"{to}.blocks", f"{to}.records"]
    assert "\n10 reads\n" in said(spark, capsys, "check-bam", to)
    with pytest.raises(SystemExit):
        cli.main(["compute-splits", path, "-m", "0"], spark)
