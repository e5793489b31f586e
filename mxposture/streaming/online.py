"""Online forms of the endpoint windows, the drift statistic and the upgrade outcome."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mxposture.constants import DRIFT_DELTA, DRIFT_LAMBDA
from mxposture.operators.sessions import CREDENTIAL_COMMANDS, HARMLESS_COMMANDS, UPGRADE_VERB
from mxposture.streaming.ordered import Fold, in_order


def daily_windows(events: DataFrame, rates: dict[str, str], late: str = "1 day") -> DataFrame:
    """Tumbling one-day windows per endpoint; rows later than ``late`` are left out.

    ``rates`` maps a rate column to the event type it counts. Works on a stream or a batch.
    """
    counts = [F.count_if(F.col("event_type") == kind).alias(f"_{name}") for name, kind in rates.items()]
    out = (
        events.withWatermark("ts", late)
        .groupBy(F.window("ts", "1 day").alias("w"), "endpoint_id")
        .agg(F.count(F.lit(1)).alias("session_count"), *counts)
    )
    return out.select(
        "endpoint_id",
        F.col("w.start").cast("date").alias("day"),
        "session_count",
        *[(F.col(f"_{n}") / F.col("session_count")).alias(n) for n in rates],
    )


#: Day 0 on the stream's clock, in days after the epoch (2000-01-01); a watermark must be positive.
DAY_ZERO = 10_957


class DriftFold(Fold):
    """Page-Hinkley statistic of one value per endpoint, by day."""

    FIELDS = ["day_index", "value"]
    OUTPUT = "day_index bigint, drift double"

    def blank(self) -> dict:
        return {"mean": 0.0, "total": 0.0, "n": 0}

    def step(self, state: dict, row: dict) -> Iterator[tuple]:
        value = row["value"]
        state["n"] += 1
        state["mean"] += (value - state["mean"]) / state["n"]
        state["total"] = max(0.0, state["total"] + value - state["mean"] - DRIFT_DELTA)
        yield row["day_index"], state["total"] / DRIFT_LAMBDA


def drift_stream(values: DataFrame, delay: str = "2 days", lifetime: str = "90 days", **more) -> DataFrame:
    """``values``: endpoint_id, day_index, value; a day's value counts at the day's time.

    An endpoint that shows nothing for ``lifetime`` starts anew.
    """
    day = F.timestamp_seconds((DAY_ZERO + F.col("day_index")) * 86_400)
    rows = values.withColumns({"ts": day, "ord": F.col("day_index")})
    return in_order(rows, ["endpoint_id"], DriftFold(), delay, lifetime, idle=lifetime, **more)


class UpgradeFold(Fold):
    """Upgrade dialogue of one session; the outcome comes when the session ends.

    A risky command after the acceptance is only a violation if no client hello is seen in the whole
    session, so both are kept as flags until then.
    """

    FLAGS = ["hello", "advertised", "requested", "accepted", "waiting", "risky", "fallback"]
    FIELDS = ["protocol", "kind", "command", "reply_code", "text", "tag", "client_hello"]
    OUTPUT = "protocol string, state string"

    def blank(self) -> dict:
        return dict.fromkeys(self.FLAGS, False) | {"protocol": None, "tag": None}

    def ends(self, row: dict) -> bool:
        return row.get("kind") == "end"

    def step(self, state: dict, row: dict) -> Iterator[tuple]:
        state["protocol"] = state["protocol"] or row.get("protocol")
        state["hello"] = bool(state["hello"] or row.get("client_hello"))
        if not self.ends(row):
            self.advance(state, row)
        return iter(())

    def finish(self, state: dict) -> Iterator[tuple]:
        yield state["protocol"], self.outcome(state)

    @staticmethod
    def outcome(s: dict) -> str | None:
        order = [
            (s["risky"] and not s["hello"], "violation"),
            (s["fallback"], "plaintext_fallback"),
            (s["accepted"] and s["hello"], "tls_established"),
            (s["accepted"], "accepted"),
            (s["requested"], "requested"),
            (s["advertised"], "advertised"),
        ]
        return next((name for hit, name in order if hit), None)

    @staticmethod
    def advance(s: dict, e: dict) -> None:
        protocol, kind = s["protocol"], e.get("kind")
        verb = UPGRADE_VERB.get(protocol, "STARTTLS")
        command, text = (e.get("command") or "").upper(), (e.get("text") or "").upper()
        words = text.split() if protocol == "smtp" else text.replace(",", " ").split()
        if kind in ("capability", "reply") and verb in words:
            s["advertised"] = True
        if protocol == "pop3" and kind == "capability" and command == verb:
            s["advertised"] = True
        if protocol == "smtp" and kind == "reply" and command == verb and e.get("reply_code") == 250:
            s["advertised"] = True
        if kind == "request" and command == verb:
            s.update(requested=True, waiting=True, tag=e.get("tag"))
        elif s["waiting"] and kind == "reply":
            code = e.get("reply_code")
            good = {
                "smtp": code is not None and 200 <= code < 300,
                "imap": text == "OK" or text.startswith("OK "),
            }.get(protocol, text.startswith(("+OK", "OK")))
            fits = protocol != "imap" or not s["tag"] or not e.get("tag") or s["tag"] == e.get("tag")
            final = protocol != "imap" or (fits and (good or text.startswith(("NO", "BAD"))))
            s["accepted"] = s["accepted"] or (good and fits)
            s["waiting"] = not final
        elif kind == "starttls":
            s["accepted"] = True
        elif kind == "unexpected" or kind == "request":
            harmful = kind == "unexpected" or command not in HARMLESS_COMMANDS.get(protocol, [])
            if kind == "request" and command in CREDENTIAL_COMMANDS.get(protocol, []) and not s["accepted"]:
                s["fallback"] = True
            if harmful and s["accepted"]:
                s["risky"] = True


def upgrade_stream(events: DataFrame, **more) -> DataFrame:
    """``events``: uid, ts, ord, protocol, kind (or ``end``), command, reply_code, text, tag, client_hello."""
    return in_order(events, ["uid"], UpgradeFold(), **more)
