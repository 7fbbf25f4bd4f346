"""Small tables with the hard cases, written once for all tests."""

from __future__ import annotations

import random

from pyspark.sql import types as T

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def sentence(draw: random.Random, words: int, stock: str) -> str:
    pool = stock.split()
    return " ".join(draw.choice(pool) + draw.choice(pool) for _ in range(words))


STOCK = {
    "en": "the and ing tion er th wh ea sh ly ou",
    "de": "der die ung sch lich keit zu ver ü ö ä",
    "fr": "le les eau tion oi é è ç que aux ment",
    "es": "ción mente ado rr ll ñ ó que os as ez",
}


def documents() -> list[tuple]:
    """Rows with nulls, copies, near copies, shared passages and lines, ties and long words."""
    draw = random.Random(4)
    rows = []
    for i in range(120):
        lang = draw.choice(list(STOCK))
        text = "\n".join(sentence(draw, draw.randint(8, 40), STOCK[lang]) for _ in range(draw.randint(1, 6)))
        rows.append((i, text, lang, f"src{i % 3}", len(text)))
    shared = sentence(draw, 90, STOCK["en"])
    line = sentence(draw, 12, STOCK["en"])
    base = rows[3][1] + "\n" + sentence(draw, 300, STOCK["en"])
    for i in range(120, 126):  # a passage that many share, and a line
        text = f"{sentence(draw, 30, STOCK['en'])} {shared} {sentence(draw, 30, STOCK['fr'])}\n{line}"
        rows.append((i, text, "en", "src0", len(text)))
    for i in range(126, 130):  # copies
        rows.append((i, base, "en", "src0", len(base)))
    for i in range(130, 138):  # near copies: one word, a letter in the line
        words = base.split(" ")
        words[draw.randrange(len(words))] = f"odd{i}"
        text = " ".join(words) + "\n" + line[:5] + draw.choice("xyz") + line[6:]
        rows.append((i, text, "en", "src0", len(text)))
    rows += [
        (138, None, "en", "src1", None),
        (139, "", "de", "src1", 0),
        (140, "   \n\t \n", None, None, 6),
        (141, "12 34 !?", "fr", None, 8),
        (142, "a" * 3000, "en", "src2", 3000),
        (143, " ".join(["same words again and"] * 900), "en", "src2", 1),
        (144, "Straße ΣΑΣ İ ﬁ <|endoftext|> \u0000 😀", "de", "src2", 1),
        (145, "x", "en", "src2", 1),
        (None, rows[10][1], "en", "src1", 5),
        (None, sentence(draw, 200, STOCK["es"]), None, None, None),
        rows[5],
        rows[5],
    ]
    return rows


def docs_frame(spark, rows: list[tuple] | None = None):
    return spark.createDataFrame(documents() if rows is None else rows, DOCS).repartition(3)


#: Names that operators use for columns of their own.
CLASHES = (
    "score lang_pred predicted ids n_words n_hit items spans kept n_lines n_dropped n_near drops fp "
    "component_id t1 t2 keys begin stop key l1 l2 line at q c v drop_id drop_text digest rest nd_words nd_more "
    "nd_text nd_root nd_node nd_group nd_id nd_t nd_least nd_shared"
).split()


def with_clashes(docs):
    from pyspark.sql import functions as F

    return docs.withColumns({name: F.lit("own") for name in CLASHES})


def schema_of(text: str) -> T.StructType:
    return T.StructType.fromDDL(text)
