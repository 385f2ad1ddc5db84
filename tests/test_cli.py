import io

import pytest

from wattframe.cli import Prompt, main
from wattframe.config import Config


@pytest.fixture()
def here(spark, tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    return tmp_path


def test_import_export_and_refusal(here, capsys):
    assert main(["export-cim", "a.xml", "--no-config"]) == 0
    assert main(["import-cim", "a.xml", "--db", "net.sqlite"]) == 0
    assert main(["query", "FIND loads WHERE energized SELECT mrid, kw", "--db", "net.sqlite", "--format", "csv"]) == 0
    assert capsys.readouterr().out.endswith("mrid,kw\nLOAD-001,310\n")
    (here / "small.dss").write_text("New Circuit.C\nNew Line.L bus1=sourcebus bus2=b")
    assert main(["import-dss", "small.dss", "--db", "net.sqlite"]) == 2
    assert "FDR-104 is gone" in capsys.readouterr().err
    assert main(["query", "FIND loads SELECT mrid RETURN cim", "--db", "net.sqlite"]) == 0
    out = capsys.readouterr().out
    assert "LOAD-002" in out and "SUB-001" in out and "BRK-001" not in out.replace('resource="#BRK-001"', "")
    assert main(["query", "FIND loads SELECT COUNT(*) RETURN cim"]) == 2
    assert main(["validate"]) == 0 and main(["import-csv", "nowhere", "--db", "x"]) == 2


def test_settings_and_scripts(here, capsys):
    assert main(["init"]) == 0 and main(["init"]) == 2
    (here / "queries").mkdir()
    (here / "queries" / "near.wq").write_text("PARAM target;\nFIND devices CONNECTED TO $target SELECT mrid")
    (here / "project.wattframe").write_text('queries = "queries"\npostgres = "host=h password=p"\n[params]\ntarget = "REC-001"\nother = 1\n')
    assert main(["config"]) == 0
    assert "password=***" in capsys.readouterr().out
    (here / "project.wattframe").write_text('queries = "queries"\n[params]\ntarget = "REC-001"\nother = 1\n')
    assert main(["run", "near", "--format", "csv"]) == 0
    assert "SW-002" in capsys.readouterr().out
    assert main(["run", "near", "--target", "LOAD-001", "--format", "csv"]) == 0
    assert "XFMR-001" in capsys.readouterr().out


def test_prompt(spark):
    out = io.StringIO()
    p = Prompt(spark, Config(), out)
    assert all(p.line(x) for x in (".help", ".types", ".format csv", "FIND feeders SELECT mrid;", ".format odd", ".nothing", "FIND nothing", "", ".validate", ".config", ".reload"))
    assert not p.line(".quit")
    text = out.getvalue()
    assert "mrid\nFDR-104" in text and "formats are" in text and "no type is called" in text and "13 objects" in text
