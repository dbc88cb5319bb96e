"""python -m moundline --pitcher NAME --season YEAR: cleans what has landed, stores it, and writes a report; --smoke prints the checks instead, --summary what the raw file holds; --check FOLDER looks at the headers of landed files."""

from __future__ import annotations

import argparse
import html
import os
import sys

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moundline import config
from moundline.functions.names import slug
from moundline.operators import metrics, quality
from moundline.operators.clean import prepare_for_storage
from moundline.session import local, ship
from moundline.sources.landing import check_source, header_report, land, numeric_counts, quarantine
from moundline.sources.players import resolve_player
from moundline.sources.remote import fetch_player_season
from moundline.sources.store import ORDINAL, PitchStore


def as_table(title: str, df: DataFrame) -> str:
    """A report table of all rows; what a report says about one pitcher is short by its nature."""
    cell = lambda v: html.escape("" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v))
    rows = "".join("<tr>" + "".join(f"<td>{cell(v)}</td>" for v in r) + "</tr>" for r in df.collect())
    return f"<h2>{html.escape(title)}</h2><table><tr>{''.join(f'<th>{c}</th>' for c in df.columns)}</tr>{rows}</table>"


def report(store: PitchStore, mlbam_id: int, season: int, name: str) -> str:
    """The pitcher's season against the league of that season that the store holds."""
    league = store.pitches.filter(F.col("game_year") == season)
    mine = store.load_pitcher_season(mlbam_id, season)
    own = lambda df: df.filter(F.col("pitcher") == mlbam_id).drop("pitcher")
    parts = [
        as_table("Takeaways", own(metrics.takeaways(league)).orderBy("place")), as_table("Pitch mix by count", metrics.pitch_mix_by_count(mine)),
        as_table("Arsenal", own(metrics.arsenal_summary(metrics.fold_rare(mine))).orderBy(F.desc("n"))), as_table("Predictability", own(metrics.count_predictability(mine)).orderBy("count")),
        as_table("What follows what", own(metrics.transitions(mine)).orderBy("previous", F.desc("n"))), as_table("Times through the order", own(metrics.times_through_order(mine)).orderBy("time")), as_table("Checks", quality.quality_checks(mine)),
    ]
    return f"<!DOCTYPE html><meta charset='utf-8'><title>{html.escape(name)} {season}</title><h1>{html.escape(name)}, {season}</h1>{''.join(parts)}"


def smoke(store: PitchStore, mlbam_id: int, season: int) -> bool:
    """Prints the checks and the profile of a stored season; whether all checks passed."""
    mine = store.load_pitcher_season(mlbam_id, season)
    checks = quality.quality_checks(mine).collect()
    for r in checks:
        print("ok  " if r.ok else "FAIL", r.check)
    print(mine.count(), "pitches;", *quality.speed_range(mine).first(), "mph")
    metrics.pitch_mix_by_count(mine).show()
    quality.value_counts(mine, "pitch_type").show()
    return all(r.ok for r in checks)


def summary(raw: DataFrame) -> None:
    """Prints what a raw file holds: rows, types of games and pitches, and the columns that are mostly empty."""
    print(raw.count(), "rows,", len(raw.columns), "columns")
    for c in ("game_type", "pitch_type", "description"):
        quality.value_counts(raw, c).show()
    quality.null_fractions(raw).show()


def main() -> None:
    ask = argparse.ArgumentParser(prog="moundline")
    ask.add_argument("--check", help="a file or folder: print which landed files are no CSV or lack columns, and stop")
    ask.add_argument("--pitcher", help="name, or id with --player-id")
    ask.add_argument("--player-id", type=int)
    ask.add_argument("--season", type=int, default=config.get("data.default_season"))
    ask.add_argument("--register", help="CSV of players, needed to find a name")
    ask.add_argument("--force-fetch", action="store_true")
    ask.add_argument("--smoke", action="store_true", help="print the checks of the stored season")
    ask.add_argument("--summary", action="store_true", help="print what the raw file holds, and stop")
    own = ask.parse_args()
    if not own.check and not own.pitcher:
        ask.error("--pitcher or --check is needed")
    spark = local()
    if own.check:
        bad = header_report(spark, own.check)
        bad.show(truncate=False)
        sys.exit(not bad.isEmpty())
    ship(spark)
    store = PitchStore(spark)
    player = own.player_id or resolve_player(spark.read.option("header", True).csv(own.register), own.pitcher).mlbam_id
    if own.force_fetch or own.summary or not store.is_cached(player, own.season):
        landed = os.path.join(config.resolve_path("data.landing_path"), f"{slug(own.pitcher)}_{own.season}_raw.csv.gz")
        if not os.path.exists(landed):
            landed = landed.removesuffix(".gz")
            os.makedirs(os.path.dirname(landed), exist_ok=True)
            with open(landed, "w") as f:
                f.write(fetch_player_season(player, own.season))
        check_source(spark, landed)
        found = land(spark, landed)
        raw = found.rows
        if lost := quarantine(found, f"{config.resolve_path('data.landing_path')}/rejected"):
            print(lost, "rows of another width than their header are in", f"{config.resolve_path('data.landing_path')}/rejected")
        if own.summary:
            summary(raw.drop(ORDINAL))
            return
        store.save_pitches(prepare_for_storage(numeric_counts(raw), keep=(ORDINAL,)), player, own.season)
    if own.smoke:
        sys.exit(not smoke(store, player, own.season))
    folder = config.resolve_path("report.output_dir")
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, f"{slug(own.pitcher)}_{own.season}.html")
    with open(path, "w") as f:
        f.write(report(store, player, own.season, own.pitcher))
    print(path)


if __name__ == "__main__":
    main()
