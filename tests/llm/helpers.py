"""Documents with everything that a table may hold, and small helpers."""

CLASHES = ("tie", "row", "line", "key", "band", "content", "size", "spans", "d", "t", "n_words", "removed", "cut", "blob", "place")
WORDS = ("alpha bravo charlie delta echo foxtrot golf hotel india juliett kilo lima mike november oscar papa quebec romeo "
         "sierra tango uniform victor whiskey xray yankee zulu").split()


def prose(n, start=0, step=1):
    return " ".join(f"{WORDS[(start + step * k) % 26]}{(start + k) // 26}" for k in range(n))


def odd_rows():
    """Null and empty texts, null and repeated ids, repeated rows, a long text, odd characters."""
    return [
        (1, prose(80)), (1, prose(80)), (2, prose(80)), (3, None), (4, ""), (4, "  \n \t"), (5, prose(60, 900, 3)),
        (5, "other text of the same number"), (None, prose(70, 500)), (None, None), (6, "x" * 70_000 + " " + prose(3000, 40)),
        (7, "é ß 中文 \U0001F600 ｱ\x0b\x00z " + prose(55, 2000)), (8, "one"), (9, "Ärger!! \r\n\r\n" + prose(50, 77) + "\n\n" + prose(50, 77)),
    ]


def frame(spark, rows):
    columns = ", ".join(f"{c} string" for c in CLASHES)
    return spark.createDataFrame([(i, t, -1 if t is None else len(t), *CLASHES) for i, t in rows],
                                 f"doc_id long, text string, n_chars long, {columns}")


def texts(rows):
    return [(i, t or "") for i, t in rows]
