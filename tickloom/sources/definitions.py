"""Messages with nested side lists: instrument definitions with tick rules, news, trading status."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.operators.ordered import carry_scan, previous

# --- fixed values of the adapter -------------------------------------------
DEFINITION_STEP = 40                 # every event with such a number carries definitions
NEWS_STEP = 97                       # and news
SYMBOLS = 7
PER_CHUNK = 4_096
# --- end of fixed values ----------------------------------------------------

_DECIMAL = "struct<mantissa:bigint,exponent:int>"
_RULE = f"struct<start_price:{_DECIMAL},end_price:{_DECIMAL},increment:{_DECIMAL}>"
RELATED = f"array<struct<symbol:string,min_price_increment:{_DECIMAL},tick_rules:array<{_RULE}>>>"


def side_messages(numbered: DataFrame) -> DataFrame:
    """Definitions, news and status changes that the events stand for, two symbols to a definition."""
    number = lambda mantissa, exponent: F.struct(mantissa.cast("bigint"), F.lit(exponent))
    symbol = lambda shift: F.concat(F.lit("S"), ((F.col("user_id") + shift) % SYMBOLS).cast("string"))

    def related(shift: int):
        base = (F.col("user_id") + shift) % SYMBOLS
        rules = F.array(
            F.struct(number(F.lit(0), 0), number(base * 1_000 + 500, -1), number(base + 1, -2)),
            F.struct(number(base * 1_000 + 500, -1), F.lit(None), number(base + 1, -1)),
        )
        return F.struct(symbol(shift), number(base + 1, -2), rules)

    defines = F.col("event_id") % DEFINITION_STEP == 0
    return numbered.select(
        "day",
        F.col("n").alias("msg_seq"),
        F.floor(F.col("n") / PER_CHUNK).alias("chunk"),
        "t_ms",
        F.when(defines, F.array(related(0), related(1)).cast(RELATED)).alias("related_sym"),
        F.when(F.col("event_id") % NEWS_STEP == 0, F.col("event_type")).alias("headline"),
        symbol(0).alias("symbol"),
        (F.col("event_id") % 3 + 17).alias("status"),
    )


def _value(number: str):
    return F.col(f"{number}.mantissa") * F.pow(F.lit(10.0), F.col(f"{number}.exponent"))


def tick_rules(messages: DataFrame) -> DataFrame:
    """Every different rule of every symbol: a generator over symbols, and one over the rules of each."""
    symbols = messages.select(F.explode("related_sym").alias("s"))
    rules = symbols.select(
        F.col("s.symbol").alias("symbol"), F.col("s.min_price_increment").alias("least"), F.explode_outer("s.tick_rules").alias("r")
    )
    return rules.select(
        "symbol",
        _value("r.start_price").alias("start_price"),
        _value("r.end_price").alias("end_price"),
        _value("r.increment").alias("increment"),
        _value("least").alias("min_price_increment"),
    ).distinct()


def news(messages: DataFrame) -> DataFrame:
    """Headlines by time, each (time, headline) once."""
    return messages.filter("headline IS NOT NULL").select("day", "t_ms", "headline").distinct()


def status_changes(messages: DataFrame) -> DataFrame:
    """Status messages in time order, those that repeat the symbol's last status left out; how long each held."""
    rows = messages.select("day", "chunk", "msg_seq", "t_ms", "symbol", "status")
    keys, order = ["day", "symbol"], ["msg_seq"]
    changed = carry_scan(rows, keys, order, [previous("_p", "status")]).filter("NOT _p.status <=> status")
    told = carry_scan(changed.drop("_p"), keys, order, [previous("_p", "t_ms", "status")])
    return told.select(
        *["day", "symbol", "msg_seq", "t_ms", "status"],
        F.col("_p.status").alias("from_status"),
        (F.col("t_ms") - F.col("_p.t_ms")).alias("held_ms"),
    )
