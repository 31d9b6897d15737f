"""Character sets of system files, as WHATWG defines them, with decoding that never fails."""

from __future__ import annotations

import codecs

# --- Fixed values: the charset of each code page, and labels that differ from Python's names ----
CODE_PAGES = {
    437: "IBM866", 850: "windows-1252", 874: "windows-874", 932: "Shift_JIS", 936: "GBK", 949: "EUC-KR", 950: "Big5",
    1200: "UTF-16LE", 1201: "UTF-16BE", 1250: "windows-1250", 1251: "windows-1251", 1252: "windows-1252",
    1253: "windows-1253", 1254: "windows-1254", 1255: "windows-1255", 1256: "windows-1256", 1257: "windows-1257",
    1258: "windows-1258", 20127: "windows-1252", 20936: "GBK", 28591: "windows-1252", 28592: "ISO-8859-2",
    28593: "ISO-8859-3", 28594: "ISO-8859-4", 28595: "ISO-8859-5", 28596: "ISO-8859-6", 28597: "ISO-8859-7",
    28598: "ISO-8859-8", 28599: "windows-1254", 28603: "ISO-8859-13", 28605: "ISO-8859-15", 50220: "ISO-2022-JP",
    51932: "EUC-JP", 51949: "EUC-KR", 52936: "GBK", 54936: "gb18030", 65001: "UTF-8",
}
LABELS = {
    "utf-8": "UTF-8", "utf8": "UTF-8", "unicode-1-1-utf-8": "UTF-8", "ascii": "windows-1252", "us-ascii": "windows-1252",
    "ansi_x3.4-1968": "windows-1252", "latin1": "windows-1252", "l1": "windows-1252", "iso-8859-1": "windows-1252",
    "iso8859-1": "windows-1252", "iso_8859-1": "windows-1252", "cp819": "windows-1252", "ibm819": "windows-1252",
    "cp1252": "windows-1252", "x-cp1252": "windows-1252", "latin2": "ISO-8859-2", "l2": "ISO-8859-2", "latin3": "ISO-8859-3",
    "latin4": "ISO-8859-4", "latin5": "windows-1254", "iso-8859-9": "windows-1254", "iso8859-9": "windows-1254",
    "cyrillic": "ISO-8859-5", "arabic": "ISO-8859-6", "greek": "ISO-8859-7", "hebrew": "ISO-8859-8", "latin6": "ISO-8859-10",
    "iso-8859-11": "windows-874", "tis-620": "windows-874", "dos-874": "windows-874", "866": "IBM866", "cp866": "IBM866",
    "ibm866": "IBM866", "shift_jis": "Shift_JIS", "shift-jis": "Shift_JIS", "sjis": "Shift_JIS", "ms_kanji": "Shift_JIS",
    "windows-31j": "Shift_JIS", "ms932": "Shift_JIS", "x-sjis": "Shift_JIS", "euc-jp": "EUC-JP", "x-euc-jp": "EUC-JP",
    "iso-2022-jp": "ISO-2022-JP", "euc-kr": "EUC-KR", "korean": "EUC-KR", "ks_c_5601-1987": "EUC-KR", "windows-949": "EUC-KR",
    "gbk": "GBK", "gb2312": "GBK", "chinese": "GBK", "gb_2312-80": "GBK", "x-gbk": "GBK", "gb18030": "gb18030",
    "big5": "Big5", "big5-hkscs": "Big5", "cn-big5": "Big5", "x-x-big5": "Big5", "koi8-r": "KOI8-R", "koi": "KOI8-R",
    "koi8-u": "KOI8-U", "macintosh": "macintosh", "mac": "macintosh", "utf-16": "UTF-16LE", "utf-16le": "UTF-16LE",
    "utf-16be": "UTF-16BE",
}
CODECS = {"IBM866": "cp866", "windows-874": "cp874", "Shift_JIS": "cp932", "GBK": "gb18030", "EUC-KR": "cp949", "Big5": "big5hkscs", "macintosh": "mac_roman"}
# ------------------------------------------------------------------------------------------
DEFAULT = "windows-1252"


def from_code_page(page: int) -> str:
    return CODE_PAGES.get(page, DEFAULT)


def from_label(label: str) -> str:
    """The charset of a label, whatever its case; one that isn't known means windows-1252."""
    name = label.strip().lower()
    if name in LABELS:
        return LABELS[name]
    if name.startswith(("windows-125", "cp125", "x-cp125")) and name[-1].isdigit():
        return f"windows-125{name[-1]}"
    for known in ("windows-874", *(f"ISO-8859-{k}" for k in (2, 3, 4, 5, 6, 7, 8, 10, 13, 14, 15, 16))):
        if name in (known.lower(), known.lower().replace("iso-", "iso"), known.lower().replace("iso-", "iso_")):
            return known
    return DEFAULT


def _control(error: UnicodeError):
    """Bytes that Python leaves undefined: in a windows charset, C1 controls; else U+FFFD."""
    if not isinstance(error, UnicodeDecodeError):
        raise error
    if error.encoding.startswith(("charmap", "cp125", "cp874")):
        byte = error.object[error.start]
        return (chr(byte) if byte < 0xA0 else "�"), error.start + 1
    return "�", error.end


codecs.register_error("quadrat-lossy", _control)


def codec_of(charset: str) -> str:
    return CODECS.get(charset) or (f"cp{charset[8:]}" if charset.startswith("windows-") else charset.lower())


def decode(raw: bytes, charset: str) -> str:
    if charset == "UTF-8":
        return raw.decode("utf-8", "replace")
    return raw.decode(codec_of(charset), "quadrat-lossy")


def extends_ascii(charset: str) -> bool:
    return not charset.startswith(("UTF-16", "ISO-2022"))
