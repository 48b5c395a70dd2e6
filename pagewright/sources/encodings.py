"""Character encodings by the labels that the web uses: a label's encoding is seldom what Python means by its name."""

from __future__ import annotations

import codecs

#: Encodings of the web by Python's names, as far as they are read as themselves.
ENCODINGS = frozenset(
    "utf-8 cp866 iso8859-2 iso8859-3 iso8859-4 iso8859-5 iso8859-6 iso8859-7 iso8859-8 iso8859-10 iso8859-13 iso8859-14 iso8859-15 iso8859-16 koi8-r koi8-u mac-roman "
    "cp874 cp1250 cp1251 cp1252 cp1253 cp1254 cp1255 cp1256 cp1257 cp1258 mac-cyrillic gb18030 big5hkscs euc_jp iso2022_jp cp932 cp949 utf-16-be utf-16-le".split()
)
#: What Python's encodings stand for on the web.
MEANT = {
    "ascii": "cp1252", "iso8859-1": "cp1252", "iso8859-9": "cp1254", "iso8859-11": "cp874", "tis-620": "cp874", "gb2312": "gb18030", "gbk": "gb18030", "big5": "big5hkscs", "shift_jis": "cp932", "euc_kr": "cp949", "utf-16": "utf-16-le",
}
#: Labels that Python doesn't know, or knows as something else.
LABELS = {
    "unicode-1-1-utf-8": "utf-8", "unicode11utf8": "utf-8", "unicode20utf8": "utf-8", "x-unicode20utf8": "utf-8", "csisolatin9": "iso8859-15", "l9": "iso8859-15", "dos-874": "cp874", "windows-874": "cp874", "csiso88598e": "iso8859-8", "csiso88598i": "iso8859-8",
    "iso-8859-8-i": "iso8859-8", "logical": "iso8859-8", "visual": "iso8859-8", "csiso88596e": "iso8859-6", "csiso88596i": "iso8859-6", "iso-8859-6-e": "iso8859-6", "iso-8859-6-i": "iso8859-6", "sun_eu_greek": "iso8859-7", "koi": "koi8-r", "koi8": "koi8-r", "koi8_r": "koi8-r", "koi8-ru": "koi8-u",
    "mac": "mac-roman", "macintosh": "mac-roman", "csmacintosh": "mac-roman", "x-mac-roman": "mac-roman", "x-mac-cyrillic": "mac-cyrillic", "x-mac-ukrainian": "mac-cyrillic", "x-gbk": "gb18030", "iso-ir-58": "gb18030", "cn-big5": "big5hkscs", "x-x-big5": "big5hkscs", "x-euc-jp": "euc_jp",
    "x-sjis": "cp932", "windows-31j": "cp932", "ms_kanji": "cp932", "ms932": "cp932", "korean": "cp949", "windows-949": "cp949", "ks_c_5601-1989": "cp949", "ksc_5601": "cp949", "ksc5601": "cp949", "iso-ir-149": "cp949", "unicodefffe": "utf-16-be",
    "unicode": "utf-16-le", "unicodefeff": "utf-16-le", "ucs-2": "utf-16-le", "csunicode": "utf-16-le", "iso-10646-ucs-2": "utf-16-le",
} | {f"x-cp125{i}": f"cp125{i}" for i in range(9)}
#: Labels of encodings that are unsafe to read; a text in one is a single U+FFFD.
REPLACED = frozenset("replacement csiso2022kr hz-gb-2312 iso-2022-cn iso-2022-cn-ext iso-2022-kr".split())
MARKS = ((b"\xef\xbb\xbf", "utf-8"), (b"\xfe\xff", "utf-16-be"), (b"\xff\xfe", "utf-16-le"))


def _undefined(e: UnicodeError) -> tuple[str, int]:
    """A single byte that a code page leaves undefined is the control character of its number."""
    if isinstance(e, UnicodeDecodeError) and 0x80 <= e.object[e.start] < 0xA0:
        return chr(e.object[e.start]), e.start + 1
    return "�", e.start + 1


codecs.register_error("pagewright.undefined", _undefined)


def encoding_of(label: str) -> str | None:
    """Python's name of the encoding that a label means; None for an unknown one."""
    label = label.strip("\t\n\f\r ").lower()
    if label in REPLACED:
        return "replacement"
    name = LABELS.get(label)
    if name is None:
        try:
            name = codecs.lookup(label).name
        except (LookupError, ValueError):
            return None
        name = MEANT.get(name, name)
    return name if name in ENCODINGS else None


def decode_as(body: bytes, label: str) -> str:
    """Text of a body; a byte order mark outranks the label, and an unknown label means UTF-8. Nothing raises."""
    for mark, name in MARKS:
        if body.startswith(mark):
            return body[len(mark) :].decode(name, "replace")
    name = encoding_of(label) or "utf-8"
    if name == "replacement":
        return "�" if body else ""
    return body.decode(name, "pagewright.undefined" if name.startswith(("cp125", "cp874", "iso8859", "koi8", "mac")) else "replace")
