"""Undoing wrong decodings of text, and words that look alike however they were decoded.

A page's bytes read with the wrong character set give typical letters. Where the letters
show it, the text is turned back into bytes and decoded again. What was lost (the
replacement character) can't come back; `words` therefore leaves out accented letters, so
that a word with a lost accent equals the same word with it.
"""

from __future__ import annotations

import html
import re
import unicodedata


def _bytes_of(charset: str, spare: str) -> dict[int, int]:
    """Character -> byte of an 8-bit character set; bytes it doesn't define as in `spare`."""
    table = {}
    for b in range(256):
        try:
            c = bytes([b]).decode(charset)
        except UnicodeDecodeError:
            c = bytes([b]).decode(spare)
        table[ord(c)] = b
    return table


_WEST, _EAST = _bytes_of("cp1252", "latin-1"), _bytes_of("cp1251", "latin-1")
_C1 = {b: b for b in range(0x80, 0xA0)}
_WEST = _C1 | _WEST
_HIGH = re.compile(r"[^\x00-\x7f]")
#: UTF-8 lead bytes followed by continuation bytes, as cp1252, latin-1 or cp1251 show them.
_UTF8_WEST = re.compile("[ÂÃÅÐÑâ][\u0080-¿ŒœŠšŸŽžƒˆ˜–-›€™�]")
_UTF8_EAST = re.compile("[ВГРСв][Ђ-Џђ-џ\u0080-¿–-›€№™ҐґЄє]")
_CYRILLIC_AS_WEST = re.compile("[À-ÿ]{3}")
_MIXED = re.compile("[a-z][а-я]|[а-я][a-z]")
#: A byte that stands for one lost in decoding; it continues a UTF-8 sequence.
_LOST = 0x81


def _to_bytes(text: str, table: dict[int, int]) -> bytes:
    return bytes(table.get(ord(c), _LOST if c == "�" else 0x3F) if ord(c) > 127 else ord(c) for c in text)


def _better(text: str, table: dict[int, int]) -> str:
    """The text decoded as UTF-8 from the bytes it was read from, if that fits; else itself."""
    again = _to_bytes(text, table).decode("utf-8", "replace")
    return again if again.count("�") <= max(text.count("�"), len(again) // 50) else text


def repair(text: str) -> str:
    """The text with the effects of a wrong character set undone, where they can be told."""
    if "&" in text:
        text = html.unescape(text)
    high = len(_HIGH.findall(text))
    if not high:
        return text
    if len(_UTF8_WEST.findall(text)) * 4 > high:
        text = _better(text, _WEST)
    elif len(_UTF8_EAST.findall(text)) * 3 > high:
        text = _better(text, _EAST)
    if len(_CYRILLIC_AS_WEST.findall(text)) * 12 > len(text):
        raw = _to_bytes(text, _WEST)
        readings = [raw.decode("cp1251", "replace"), raw.decode("koi8-r", "replace")]
        text = max(readings, key=lambda t: sum("а" <= c <= "я" for c in t))
    elif len(_MIXED.findall(text)) > 2:
        text = _to_bytes(text, _EAST).decode("cp1252", "replace")
    return text


_DROP = re.compile("[̀-ͯ­​-‏﻿�À-ÖØ-öø-ſ]")
_ASCII = re.compile("[a-z]{3,}")
#: Scripts without spaces between words, and letters with the vowel signs of scripts that write them apart.
_DENSE = r"[฀-๿぀-ヿ㐀-鿿가-힯]"
_LETTER = rf"(?:(?!{_DENSE})[^\W\d_]|[֑-ׇً-ٟऀ-ॣ॰-෿])"
_APART = re.compile("[֑-ׇً-ٟऀ-෿฀-๿぀-ヿ㐀-鿿가-힯]")
_WORD = re.compile(rf"(?=({_DENSE}{{2}}))|({_LETTER}{{3,}})")
_PLAIN = re.compile(r"[^\W\d_]{3,}")


def words(text: str) -> list[str]:
    """Lower-case words of three letters or more of a repaired text, in any script, without accented Latin letters.

    Scripts without spaces between words give overlapping pairs of signs.
    """
    if text.isascii():
        return _ASCII.findall(text.lower())
    text = _DROP.sub("", unicodedata.normalize("NFC", text))
    if not _APART.search(text):
        return _PLAIN.findall(text.lower())
    return [m[1] or m[2] for m in _WORD.finditer(text.lower())]
