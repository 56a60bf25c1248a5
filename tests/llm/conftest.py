from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fingerprint string, score int"


def fixture_texts() -> list[tuple[int | None, str | None]]:
    """Copies, near copies, nulls, empty, blank, odd, multilingual and very long texts, repeated rows and a null key."""
    rng = random.Random(11)
    words = "the of and river stone light paper winter garden silver house quiet letter morning copper window".split()
    base = [" ".join(rng.choice(words) for _ in range(rng.randint(5, 120))) for _ in range(30)]
    rows = list(enumerate(base))
    rows += [(100 + k, base[k % 3]) for k in range(12)]
    rows += [(200 + k, base[5] + f" extra{k}") for k in range(6)]
    odd = ["", None, "   ", "\n\t ", "a", "Mail a.b@mail.example.com now, +1 (974) 555-3436!", "4111 1111 1111 1111 and 10.0.0.1 or 300.1.1.1", "x" * 3000,
           "".join(map(chr, (0x6F22, 0x5B57, 0x3000, 0x304B, 0x306A, 0xFF0C))) * 40, "caf" + chr(0xE9) + " e" + chr(0x301) + " " + chr(0x1F642) + chr(0xA0) + " done", "<|endoftext|> inside <|endoftext|>",
           "It's we'll DON'T 12345", "LOUD!! WORDS!! HERE!!", "nul" + chr(0) + "byte " + chr(0x1C) + " sep"]
    rows += [(300 + k, t) for k, t in enumerate(odd)]
    rows += [(400, " ".join(rng.choice(words) for _ in range(15_000)))]
    rows += [(7, base[7]), (7, base[7]), (None, "no key here"), (None, None)]
    return rows


@pytest.fixture(scope="session")
def rows():
    return fixture_texts()


def frame(spark, rows):
    return spark.createDataFrame([(k, t, "en" if k and k % 2 else None, "s", None, "clash", 1) for k, t in rows], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark, rows):
    return frame(spark, rows).repartition(3).persist()


@pytest.fixture(scope="session")
def empty(spark):
    return frame(spark, [])


@pytest.fixture
def make(spark):
    return lambda rows: frame(spark, rows)


@pytest.fixture(scope="session")
def tables(spark, rows, tmp_path_factory):
    """A folder with documents and labels."""
    out = str(tmp_path_factory.mktemp("tables"))
    frame(spark, rows).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame([(k, int((k or 0) % 5 > 0), 0) for k, _ in rows], "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    return out
