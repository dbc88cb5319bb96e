"""A transport without a network, found by its name on the workers: what it is asked for shows in its rows."""

import os

HEADER = "pitch_type,game_pk,at_bat_number,pitch_number,pitcher,batter,game_year,balls,strikes,extra"


def answer(player, season):
    return HEADER + "\n" + "".join(f"FF,{season}{i},1,{i},{player},9{i},{season},0,NA,x\n" for i in range(3))


def transport(params, timeout):
    log = os.environ.get("FAKE_REMOTE_LOG")
    player, season = int(params.get("pitchers_lookup[]") or params.get("batters_lookup[]")), int(params["hfSea"].rstrip("|"))
    if log:
        with open(log, "a") as f:
            f.write(f"{player} {season}\n")
    if player == 13:
        raise OSError("down")
    if player == 14:
        return "<html>busy</html>"
    return answer(player, season) if season > 2000 else HEADER + "\n"


def by_dates(player, first, last, kind):
    """A year more than asked for, columns in another order."""
    season = int(first[:4])
    lines = [x.split(",")[::-1] for x in (answer(player, season) + answer(player, season - 1).split("\n", 1)[1]).split("\n") if x]
    return "".join(",".join(x) + "\n" for x in lines)
