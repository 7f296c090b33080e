"""The encoding of text files: marks, validity, and else the reading whose characters fit together best."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes of a file by which its encoding is told; all of it is decoded.
SAMPLE = 65536
#: Byte order marks and the codecs that they stand for.
MARKS = [(b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe\x00\x00", "utf-32-le"), (b"\x00\x00\xfe\xff", "utf-32-be"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")]
#: Readings that are tried where there is no mark and the bytes are no UTF-8; of equal scores the first.
READINGS = ["utf-16-le", "utf-16-be", "cp1252", "cp1250", "iso8859-2", "cp1251", "koi8-r", "iso8859-5", "cp1253", "cp1254", "cp932", "euc_jp", "gb18030", "big5", "euc_kr"]
#: Letters beyond ASCII that texts of a language group use often, those of Western Europe, Central Europe, Turkey, Russia and Greece.
FREQUENT = set("éèàùâêîôûçëïäöüßñáíóúãõåæøœ" + "ąćęłńśźżěščřžýůťďňőűđ" + "ğışİ" + "оеаинтсрвлкмдпуяыьгзбчйхжшю" + "αοιετσνηυρκμλπάέίόήώςδγ")
#: The most frequent characters of Chinese texts.
HAN = set("的一是不了在人有我他这中大来上个国和也子时道出而要于就下得可你年生" "這個來國時們說為學會對") | set("日本人年大学時間中国会社")
MARKS_OF_TEXT = set("’‘“”„–—…«»¿¡€°§©®№·•")


@lru_cache(1 << 14)
def _kind(c: str) -> str:
    """A character's script and case in short: what letters beside it should share."""
    code = ord(c)
    if c.isalpha():
        if code < 0x250 or 0x1E00 <= code < 0x1F00:
            return "L" if c.isupper() else "l"
        if 0x370 <= code < 0x400:
            return "G" if c.isupper() else "g"
        if 0x400 <= code < 0x530:
            return "R" if c.isupper() else "r"
        if 0x3040 <= code < 0x3100:
            return "kana"
        if 0x4E00 <= code < 0xA000:
            return "han"
        if 0xAC00 <= code < 0xD7A4:
            return "hangul"
        return "other"
    if c.isdigit():
        return "0"
    if c.isspace():
        return " "
    category = unicodedata.category(c)
    return "bad" if category in ("Cc", "Cn", "Co", "Cs") else "sign"


def fitness(text: str, most: int = 4096) -> float:
    """The mean over the characters beyond ASCII (the first `most`) of how well each fits its neighbours and what texts use: log odds by rule, about 2 for a right reading, below 0 for a wrong one."""
    total, n, last = 0.0, 0, " "
    for i, c in enumerate(text):
        kind = _kind(c)
        if kind == "bad" and c not in "\t\n\r\f":
            total -= 6
            n += 1
        elif c > "\x7f":
            n += 1
            after = _kind(text[i + 1]) if i + 1 < len(text) else " "
            beside = [k for k in (last, after) if k not in (" ", "sign", "0")]
            if kind in ("L", "l", "G", "g", "R", "r"):
                same = all(k.lower() == kind.lower() for k in beside)
                total += 1 if same else -2
                total += 1 if c.lower() in FREQUENT else -0.7
                if kind.isupper() and last.islower() and last in "lgr":
                    total -= 2  # a capital within a word
                elif kind.islower() and last.isupper() and last in "LGR" and after in ("L", "G", "R"):
                    total -= 1
                elif kind.islower() and last == " " and after in ("L", "G", "R"):
                    total -= 2  # a small letter that a capital follows
                if not beside:
                    total -= 0.7
            elif kind == "kana":
                total += 2.5 if c < "・" else 0.5
            elif kind == "han":
                total += 1.8 if c in HAN else 0.2 if "kana" in beside or "han" in beside else -1
            elif kind == "hangul":
                total += 2 if "hangul" in beside else -0.5
            elif c in "。、「」・（），！？：；　":
                total += 1.5
            elif kind in (" ", "sign", "0"):
                total += (1.5 if c in "¿¡" and last == " " else 0.5) if c in MARKS_OF_TEXT or c == "\xa0" else -1.5
            else:
                total -= 1.5
        last = kind
        if n >= most:
            break
    return total / n if n else 0.0


def _wide(head: bytes) -> str | None:
    """UTF-16 without a mark: every other byte is zero, or both readings are told apart by their fitness."""
    if len(head) < 4:
        return None
    even, odd = head[0::2].count(0) / len(head[0::2]), head[1::2].count(0) / max(1, len(head[1::2]))
    if odd > 0.3 and even < 0.1:
        return "utf-16-le"
    if even > 0.3 and odd < 0.1:
        return "utf-16-be"
    return None


def _reads(head: bytes, codec: str) -> str | None:
    """A sample in a codec; a character that the sample's end cuts does not count."""
    for cut in range(4):
        try:
            return head[: len(head) - cut].decode(codec)
        except UnicodeDecodeError as e:
            if e.start < len(head) - 8 or codec.startswith(("cp125", "iso", "koi")):
                return None
    return None


def detect(content: bytes) -> str:
    """The name of a file's encoding; `binary` where nothing reads as text."""
    head = content[:SAMPLE]
    for mark, name in MARKS:
        if head.startswith(mark):
            return name
    found = _wide(head)
    if found and _reads(head, found) is not None:
        return found
    if 0 not in head and _reads(head, "utf-8") is not None and len(head) < SAMPLE:
        return "utf-8"
    if 0 not in head and (text := _reads(head, "utf-8")) is not None and text:
        return "utf-8"
    best, name = -0.5, "binary"
    for codec in READINGS:
        if codec.startswith("utf-16") and len(content) % 2:
            continue
        if (text := _reads(head, codec)) is None:
            continue
        score = fitness(text)
        if codec in ("cp932", "euc_jp", "gb18030", "big5", "euc_kr") and not any(_kind(c) in ("kana", "han", "hangul") for c in text if c > "\x7f"):
            continue
        if score > best + 1e-9:
            best, name = score, codec
    if name == "cp1252" and not any(0x80 <= b < 0xA0 for b in head):
        return "iso8859-1"
    return name


def decode(content: bytes) -> tuple[str, str | None]:
    """(encoding, text): all of a file's text. Bytes that the encoding does not have are replaced; a binary file has no text."""
    name = detect(content)
    if name == "binary":
        return name, None
    raw = content
    for mark, marked in MARKS:
        if marked == name and content.startswith(mark):
            raw = content[len(mark) :]
    return name, raw.decode("utf-8" if name == "utf-8-sig" else name, "replace")


def decoded(content: Column) -> Column:
    """(encoding, text) of a file's bytes. Valid UTF-8 without a mark or zero bytes stays with Spark; only other files go to Python."""
    head = F.hex(F.substring(content, 1, 3))
    plain = F.is_valid_utf8(content) & (head != "EFBBBF") & ~F.contains(content, F.lit(bytearray(b"\0")))

    @F.pandas_udf("encoding string, text string")
    def read(content: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([decode(bytes(c)) if c is not None else (None, None) for c in content], columns=["encoding", "text"])

    other = read(F.when(~plain, content))
    return F.when(plain, F.struct(F.lit("utf-8").alias("encoding"), content.cast("string").alias("text"))).otherwise(other)
