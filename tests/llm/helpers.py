"""Frames that every operator must take: nulls, empty and long texts, repeated rows, empty tables, extra columns."""

WORDS = "the of and water river stone letter number garden window simple green yellow people market winter summer".split()


def text(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "s", "ing"]) for _ in range(n))


def hard_rows(rng):
    long = text(rng, 6000)
    return [(0, text(rng, 50)), (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, long), (6, long), (7, text(rng, 30)), (7, text(rng, 30)), (8, "Ünïcödé 漢字 🙂   x"), (None, text(rng, 40)), (9, "a\x0bb\x0cc\rd")]


def documents(spark, rows):
    """doc_id and text, and columns whose names operators use themselves."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, id long, fp long, kd long, tokens int, t string, w string, text_hash long, component_id long, _id long, copies int, score double, y int, layout string"
    return spark.createDataFrame([(i, t, "en", "src1", len(t or ""), 5, 6, 7, 8, "t", "w", 1, 2, 3, 4, 0.5, 1, "l") for i, t in rows], schema)
