from test_core import LAW

from tessera.__main__ import main


def test_from_texts_to_answers(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "law.txt").write_text(LAW, encoding="utf-8")
    (tmp_path / "terms.csv").write_text("name,label\nvendeur,Actor\n")
    base = ["--work", str(tmp_path / "w"), "--profile", "statutes"]
    assert main(["all", *base, "--input", str(tmp_path / "in"), "--gazetteer", str(tmp_path / "terms.csv")]) == 0
    assert main(["cost", *base]) == 0
    assert main(["init", *base]) == 0
    assert main(["load", *base, "--records", str(tmp_path / "w" / "records"), "--resolve"]) == 0
    assert main(["validate", *base, "--indexes"]) in (0, 1)
    capsys.readouterr()
    assert main(["query", "vente", *base, "-k", "2", "--mode", "text"]) == 0
    out = capsys.readouterr().out
    assert "Le vendeur d" in out and "EXCEPTION_TO" in out


def test_page_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.pdf").write_text(LAW.replace("CHAPITRE 2", "\fCHAPITRE 2"), encoding="utf-8")
    base = ["--work", str(tmp_path / "w")]
    assert main(["extract", *base, "--input", str(tmp_path / "in"), "--engine", "text"]) == 0
    assert main(["segment", *base]) == 0
    rows = spark.read.json(str(tmp_path / "w" / "chunks")).collect()
    assert {r.number: r.page for r in rows} == {"1": 1, "2": 1, "12": 2, "13": 2, "14": 2}
