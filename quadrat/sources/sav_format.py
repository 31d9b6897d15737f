"""Fixed facts of the SPSS system-file format, and the errors of its reader."""

from __future__ import annotations

from typing import NamedTuple

# --- Fixed values of the format -----------------------------------------------------------
MAGIC_PLAIN, MAGIC_ZLIB = b"$FL2", b"$FL3"
HEADER_BYTES = 176
COMPRESSIONS = {0: "none", 1: "bytecode", 2: "zlib"}
MEASURES = {0: "unknown", 1: "nominal", 2: "ordinal", 3: "scale"}
ALIGNMENTS = {0: "left", 1: "right", 2: "center"}
SYSMIS = 0xFFEFFFFFFFFFFFFF
HIGHEST = float.fromhex("0x1.fffffffffffffp+1023")
LOWEST = float.fromhex("-0x1.ffffffffffffep+1023")
OP_SKIP, OP_END, OP_RAW, OP_BLANK, OP_SYSMIS = 0, 252, 253, 254, 255
EPOCH_SECONDS = 12_219_379_200  # from 14 October 1582 to 1 January 1970
EPOCH_DAYS = 141_428
SEGMENT_SLOTS, SEGMENT_BYTES, SEGMENT_WIDTH = 32, 255, 252
FORMATS = {
    1: "A", 2: "AHEX", 3: "COMMA", 4: "DOLLAR", 5: "F", 6: "IB", 7: "PIBHEX", 8: "P", 9: "PIB", 10: "PK", 11: "RB",
    12: "RBHEX", 15: "Z", 16: "N", 17: "E", 20: "DATE", 21: "TIME", 22: "DATETIME", 23: "ADATE", 24: "JDATE",
    25: "DTIME", 26: "WKDAY", 27: "MONTH", 28: "MOYR", 29: "QYR", 30: "WKYR", 31: "PCT", 32: "DOT", 33: "CCA",
    34: "CCB", 35: "CCC", 36: "CCD", 37: "CCE", 38: "EDATE", 39: "SDATE", 40: "MTIME", 41: "YMDHMS",
}
DATES = {"DATE", "ADATE", "JDATE", "EDATE", "SDATE", "MOYR", "QYR", "WKYR"}
TIMESTAMPS = {"DATETIME", "YMDHMS"}
DURATIONS = {"TIME", "DTIME", "MTIME"}
WITHOUT_DECIMALS = {"A", "AHEX", "WKDAY", "MONTH"} | DATES | TIMESTAMPS | DURATIONS
# ------------------------------------------------------------------------------------------


class SavError(IOError):
    """A system file that can't be read."""


class InvalidVariable(SavError):
    """A name that isn't a variable of the file."""


class Format(NamedTuple):
    """A print or write format: what it is called, and its width and decimals."""

    name: str
    width: int
    decimals: int

    @classmethod
    def unpack(cls, packed: int) -> Format | None:
        name = FORMATS.get(packed >> 16 & 0xFF)
        return name and cls(name, packed >> 8 & 0xFF, packed & 0xFF)

    def __str__(self) -> str:
        return f"{self.name}{self.width}" + ("" if self.name in WITHOUT_DECIMALS else f".{self.decimals}")

    @property
    def kind(self) -> str:
        """What a numeric variable of this format holds: date, timestamp, duration or double."""
        for kind, names in (("date", DATES), ("timestamp", TIMESTAMPS), ("duration", DURATIONS)):
            if self.name in names:
                return kind
        return "double"


def round_up(n: int, to: int) -> int:
    return -(-n // to) * to
