"""Small frames with every awkward row, and plain versions of what operators compute."""

import random
import re
import zlib

DOCS_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, row long, salt int, label string"
WORDS = "the of and to in is that it was for on are with as his they at be this from or had by hot but some what there we can out other were all your when up use word how said an each she".split()


def text(seed: int, n: int) -> str:
    rnd = random.Random(seed)
    return " ".join(rnd.choice(WORDS) for _ in range(n))


def rows() -> list[tuple]:
    """Nulls in every column, empty, blank and very long texts, copies and near copies, repeated rows."""
    texts = [text(s, 30 + 5 * s) for s in range(12)]
    near = texts[5].split()
    near[20] = "changed"
    texts += [texts[3], " ".join(near), texts[3].upper(), "", " \n\t ", None, "a b c", "A B c", "word", "x" * 40_000,
              text(90, 9_000), "Released under the MIT License.\n" + texts[2], "été déjà vu où ça nähe über straße" * 4,
              "1234 5678 !!! ###", "line one here\nline one here\n" * 9, "é́ 　 ΣΑΣ <|endoftext|> it's"]
    out = [(i, t, ("en", "fr", None)[i % 3], ("a", "b", None)[i % 3] if i % 2 else "hot", len(t or ""), -i, i, i, "x") for i, t in enumerate(texts)]
    return [*out, out[0], out[3], (None, texts[1], None, None, None, None, None, None, None), (None,) * 9]


def docs(spark):
    return spark.createDataFrame(rows(), DOCS_SCHEMA)


def empty(spark):
    return spark.createDataFrame([], DOCS_SCHEMA)


def fold(key, divisor: int) -> int:
    return zlib.crc32(("" if key is None else str(key)).encode()) % divisor


def split(t: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def lower(t: str | None) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def key(row) -> tuple:
    return tuple((x is not None, x) for x in row)
