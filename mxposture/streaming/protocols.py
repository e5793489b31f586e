"""Protocol events from raw dissector events: listing mode, confirmation, ambiguous greetings."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mxposture.operators.scale import CHUNK_ROWS, running
from mxposture.streaming.ordered import Fold, in_order

# First payload bytes of the client and of the server, with POSIX classes.
SIGNATURES = {
    "smtp": (
        r"(|.*[\n\r])[[:space:]]*([hH][eE][lL][oO]|[eE][hH][lL][oO])",
        r"^[[:space:]]*220[[:space:]-]",
    ),
    "imap": (
        r"(|.*[\r\n])[a-zA-Z0-9._-]+[ \t]+([cC][aA][pP][aA][bB][iI][lL][iI][tT][yY]|[sS][tT][aA][rR][tT][tT][lL][sS]|[lL][oO][gG][oO][uU][tT]|[nN][oO][oO][pP])",
        r"^\* OK",
    ),
    "pop3": (
        r"(|.*[\r\n])[[:space:]]*([uU][sS][eE][rR][[:space:]]|[cC][aA][pP][aA]|[sS][tT][lL][sS]|[qQ][uU][iI][tT]|[sS][tT][aA][tT]|[aA][uU][tT][hH])",
        r"^\+OK",
    ),
}
GREETING = r"^[\x20-\x7e]{3,80}\r\n"


def from_start(pattern: str) -> str:
    """A signature in Java's syntax, held to the first byte of the payload."""
    return "(?s)^" + pattern.removeprefix("^").replace("[:space:]", r"\s")


def identify_payload(payloads: DataFrame) -> DataFrame:
    """Protocols of a connection whose client and server signature both match.

    ``payloads``: uid, is_orig, payload (first bytes). Matches are booleans that merge map-side.
    """
    aggs = []
    for name, (client, server) in SIGNATURES.items():
        c = F.col("is_orig") & F.col("payload").rlike(from_start(client))
        s = ~F.col("is_orig") & F.col("payload").rlike(from_start(server))
        aggs += [F.max(c).alias(f"_c_{name}"), F.max(s).alias(f"_s_{name}")]
    sides = payloads.groupBy("uid").agg(
        *aggs, F.max(~F.col("is_orig") & F.col("payload").rlike(GREETING)).alias("greeting")
    )
    found = F.array_compact(
        F.array(*[F.when(F.col(f"_c_{n}") & F.col(f"_s_{n}"), n) for n in SIGNATURES])
    )
    return sides.select("uid", found.alias("protocols"), F.coalesce("greeting", F.lit(False)).alias("greeting"))


def protocol_events(raw: DataFrame, width: int = CHUNK_ROWS) -> DataFrame:
    """Batch form. ``raw``: uid, ord, protocol, kind (request, reply, data, greeting, end, ...), command, text.

    Data lines count as capabilities only between a CAPA request and the closing dot. A greeting
    becomes an ambiguous banner when the connection was never confirmed.
    """
    line = F.col("kind") == "data"
    dot = line & (F.col("text") == ".")
    capa = F.coalesce(F.upper("command") == "CAPA", F.lit(False))
    mode = F.when(F.col("kind") == "request", capa).when(dot, F.lit(False))
    mode = F.when(F.col("protocol") == "pop3", mode)
    rows = running(raw, ["uid"], ["ord"], lasts={"_listing": mode}, width=width)
    listed = line & ~dot & (F.length("text") > 0) & F.coalesce("_listing", F.lit(False))
    events = rows.where(~F.col("kind").isin("data", "greeting", "end") | listed).select(
        "uid",
        "ord",
        "protocol",
        F.when(line, "capability").otherwise(F.col("kind")).alias("kind"),
        "text",
    )
    greeted = raw.where(F.col("kind").isin("greeting", "end")).groupBy("uid").agg(
        F.max(F.when(F.col("kind") == "end", F.col("ord"))).alias("ord"),
        F.max(F.col("kind") == "greeting").alias("_g"),
    )
    vague = greeted.where(F.col("_g") & F.col("ord").isNotNull()).join(
        events.select("uid").distinct(), "uid", "left_anti"
    )
    return events.unionByName(
        vague.select(
            "uid",
            "ord",
            F.lit("unknown").alias("protocol"),
            F.lit("ambiguous_banner").alias("kind"),
            F.lit(None).cast("string").alias("text"),
        )
    )


class ProtocolFold(Fold):
    """Stream form: three flags per connection until it ends, by an end row or by silence."""

    FIELDS = ["protocol", "kind", "command", "text"]
    OUTPUT = "ord bigint, protocol string, kind string, text string"

    def blank(self) -> dict:
        return {"confirmed": False, "greeted": False, "listing": False, "last": 0}

    def ends(self, row: dict) -> bool:
        return row.get("kind") == "end"

    def step(self, state: dict, row: dict) -> Iterator[tuple]:
        kind, text = row.get("kind"), row.get("text")
        state["last"] = row["ord"]
        if kind == "greeting":
            state["greeted"] = True
        elif kind == "data":
            if text == ".":
                state["listing"] = False
            elif state["listing"] and text:
                state["confirmed"] = True
                yield row["ord"], row.get("protocol"), "capability", text
        elif kind != "end":
            if kind == "request" and row.get("protocol") == "pop3":
                state["listing"] = (row.get("command") or "").upper() == "CAPA"
            state["confirmed"] = True
            yield row["ord"], row.get("protocol"), kind, text

    def finish(self, state: dict) -> Iterator[tuple]:
        if state["greeted"] and not state["confirmed"]:
            yield state["last"], "unknown", "ambiguous_banner", None


def protocol_stream(raw: DataFrame, **more) -> DataFrame:
    """``raw``: uid, ts, ord, protocol, kind, command, text."""
    return in_order(raw, ["uid"], ProtocolFold(), **more)
