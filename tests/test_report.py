"""The command from a landed file to a report, without a network."""

import gzip
import sys

import pytest

from moundline import __main__ as cli
from moundline import config
from moundline.sources.store import PitchStore
from tests.test_store import CSV, line


def test_command(spark, tmp_path, monkeypatch):
    for key, value in {"store_path": "store", "landing_path": "in"}.items():
        monkeypatch.setitem(config.DEFAULTS["data"], key, str(tmp_path / value))
    monkeypatch.setitem(config.DEFAULTS["report"], "output_dir", str(tmp_path / "out"))
    (tmp_path / "in").mkdir()
    with gzip.open(tmp_path / "in/tarik_skubal_2025_raw.csv.gz", "wt") as f:
        f.write(CSV + "".join(line(pitcher=669373, at_bat_number=i // 4, pitch_number=i % 4 + 1, pitch_type="SL" if i % 3 else "FF", stand="L" if i % 2 else "R") for i in range(120)))
    (tmp_path / "players.csv").write_text("key_mlbam,name_first,name_last,mlb_played_first,mlb_played_last\n669373,Tarik,Skubal,2020.0,2025.0\n1,Other,One,,\n")
    monkeypatch.setattr(cli, "local", lambda: spark)
    monkeypatch.setattr(sys, "argv", ["moundline", "--pitcher", "Tarik Skubal", "--season", "2025", "--register", str(tmp_path / "players.csv")])
    for _ in range(2):  # the second time from the store
        cli.main()
    text = (tmp_path / "out/tarik_skubal_2025.html").read_text()
    assert "Pitch mix by count" in text and "<td>0-0</td>" in text and PitchStore(spark, str(tmp_path / "store")).fetch_log.first().row_count == 120
    monkeypatch.setattr(sys, "argv", ["moundline", "--season", "2025"])
    with pytest.raises(SystemExit):
        cli.main()


def test_whole_table(spark):
    assert cli.as_table("What follows what", spark.range(64)).count("<td>") == 64
