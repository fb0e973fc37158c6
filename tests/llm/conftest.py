import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = "_doc long, _row long, n_lines string, kept string, score string, spans string, n_entities string, h string, digest string, unit string, n_words string"


@pytest.fixture(scope="session")
def table(spark):
    """A maker of documents tables from (doc_id, text) pairs; clash adds columns named like the operators' own."""

    def make(pairs, clash=False, parts=3):
        rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in pairs]
        df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
        if clash:
            from pyspark.sql import functions as F

            df = df.withColumns({c.split()[0]: F.lit("clash") for c in CLASH.split(", ")})
        return df

    return make


@pytest.fixture(scope="session")
def odd():
    """Nulls, empty and blank texts, one very long text, ties and repeated rows."""
    line = "The quick brown fox jumps over the lazy dog."
    return [
        (1, None), (2, ""), (3, "   \n\t "), (4, "\n".join([line, "short", line])), (4, "\n".join([line, "short", line])), (5, line), (6, line.upper() + "\nother words stand here today."),
        (7, " ".join(f"w{i % 977}x{i % 13}" for i in range(30000)) + "\n" + line), (None, line), (None, None), (8, "é ü ñ 中文 😀 " + line), (9, "a\n\n\nb"), (9, "quite another text under the same id"),
    ]
