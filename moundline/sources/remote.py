"""The remote source: one player's season as CSV, politely, into the landing folder. Runs on the driver by intent.

There is one rate limit for the process, so requests are not spread over executors.
"""

from __future__ import annotations

import logging
import time
from collections.abc import Callable
from urllib.parse import urlencode
from urllib.request import Request, urlopen

from moundline import config
from moundline.sources.landing import BadSource, is_html

log = logging.getLogger(__name__)

#: The query parameters that the endpoint expects besides the season and the player; leaving an empty one out can change the result.
PARAMETERS = {
    "hfPT": "",
    "hfAB": "",
    "hfPR": "",
    "hfZ": "",
    "hfStadium": "",
    "hfBBL": "",
    "hfNewZones": "",
    "hfPull": "",
    "hfC": "",
    "hfSit": "",
    "hfOuts": "",
    "hfOpponent": "",
    "pitcher_throws": "",
    "batter_stands": "",
    "hfSA": "",
    "game_date_gt": "",
    "game_date_lt": "",
    "hfMo": "",
    "hfTeam": "",
    "home_road": "",
    "hfRO": "",
    "position": "",
    "hfInfield": "",
    "hfOutfield": "",
    "hfInn": "",
    "hfBBT": "",
    "all": "true",
    "hfGT": "R|PO|",
    "min_pitches": "0",
    "min_results": "0",
    "group_by": "name",
    "sort_col": "pitches",
    "player_event_sort": "api_p_release_speed",
    "sort_order": "desc",
    "min_pas": "0",
    "type": "details",
}

Transport = Callable[[dict[str, str], float], str]


def build_params(mlbam_id: int, season: int, player_type: str) -> dict[str, str]:
    who = {"pitcher": "pitchers_lookup[]", "batter": "batters_lookup[]"}[player_type]
    return PARAMETERS | {"hfSea": f"{season}|", "player_type": player_type, who: str(mlbam_id)}


def http(params: dict[str, str], timeout: float, endpoint: str | None = None) -> str:
    """The default transport; the address is a setting."""
    request = Request(f"{endpoint or config.get('data.endpoint')}?{urlencode(params)}", headers={"User-Agent": "moundline/0.1", "Accept": "text/csv,*/*"})
    with urlopen(request, timeout=timeout) as got:
        return got.read().decode()


class RateLimit:
    """At least ``gap`` seconds between calls."""

    def __init__(self, gap: float, now: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.gap, self.now, self.sleep, self.last = gap, now, sleep, float("-inf")

    def wait(self) -> None:
        rest = self.last + self.gap - self.now()
        if rest > 0:
            self.sleep(rest)
        self.last = self.now()


_LIMIT: list[RateLimit] = []


def fetch_player_season(
    mlbam_id: int, season: int, player_type: str = "pitcher", transport: Transport = http, fallback: Callable[[int, str, str, str], str] | None = None,
    limit: RateLimit | None = None, sleep: Callable[[float], None] = time.sleep, tries: int | None = None, timeout: float | None = None,
) -> str:
    """The CSV text, with tries and timeout of the settings if None. Each failure is tried again after 2, 4, ... seconds; then ``fallback`` (id, first day, last day, type) has its turn.

    A table without rows is a result. If all fail, the error carries both messages.
    """
    if player_type not in ("pitcher", "batter"):
        raise ValueError(f"player_type is pitcher or batter, not {player_type!r}")
    if limit is None:
        if not _LIMIT:
            _LIMIT.append(RateLimit(config.get("data.seconds_between_requests", 3)))
        limit = _LIMIT[0]
    tries, timeout, error = tries or config.get("data.max_retries", 3), timeout or config.get("data.request_timeout_seconds", 120), None
    for attempt in range(1, tries + 1):
        limit.wait()
        try:
            text = transport(build_params(mlbam_id, season, player_type), timeout)
            if is_html(text):
                raise BadSource("HTML instead of CSV")
            if text.count("\n") < 2 and len(text.strip().splitlines()) < 2:
                log.warning("no rows for %s in %s", mlbam_id, season)
            return text
        except Exception as e:  # noqa: BLE001  anything may pass
            error = e
            if attempt < tries:
                sleep(2**attempt)
    try:
        if fallback is None:
            raise BadSource("there is no fallback")
        return fallback(mlbam_id, f"{season}-01-01", f"{season}-12-31", player_type)
    except Exception as e:
        raise BadSource(f"{player_type} {mlbam_id}, season {season}: {error}; fallback: {e}") from e
