"""The metadata of a survey file, and the differences of two of them, as objects."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from quadrat.sources.sav_format import HIGHEST, LOWEST

_MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


def number_text(v: float) -> str:
    """Whole numbers without a point; the ends of open ranges by name."""
    if v >= HIGHEST:
        return "HIGH"
    if v <= LOWEST:
        return "LOW"
    return str(int(v)) if v == v and abs(v) != float("inf") and v == int(v) else repr(v)


def value_text(v: float | str) -> str:
    return v if isinstance(v, str) else number_text(v)


def header_datetime(date: str, time: str) -> str:
    """`16 Feb 26` and `10:38:17` as 2026-02-16 10:38:17; what isn't a date stays as it is."""
    parts = date.split()
    if len(parts) == 3 and parts[0].isdigit() and int(parts[0]) and parts[1].lower() in _MONTHS:
        year = 2000 + (int(parts[2]) if parts[2].isdigit() else 0)
        return f"{year:04}-{_MONTHS.index(parts[1].lower()) + 1:02}-{int(parts[0]):02} {time}"
    return f"{date} {time}"


@dataclass(frozen=True)
class SpssMetadata:
    """All that a file's dictionary says. Maps are keyed by variable name, in file order."""

    file_label: str = ""
    file_encoding: str = "windows-1252"
    compression: str = "none"
    creation_time: str = ""
    modification_time: str = ""
    notes: list[str] = field(default_factory=list)
    number_rows: int | None = None
    number_columns: int = 0
    file_format: str = "sav"
    variable_names: list[str] = field(default_factory=list)
    labelled: dict[str, str] = field(default_factory=dict)
    spss_variable_types: dict[str, str] = field(default_factory=dict)
    variable_types: dict[str, str] = field(default_factory=dict)
    variable_value_labels: dict[str, dict[float | str, str]] = field(default_factory=dict)
    variable_alignment: dict[str, str] = field(default_factory=dict)
    variable_storage_width: dict[str, int] = field(default_factory=dict)
    variable_display_width: dict[str, int] = field(default_factory=dict)
    variable_measure: dict[str, str] = field(default_factory=dict)
    variable_missing: dict[str, list[dict]] = field(default_factory=dict)
    mr_sets: dict[str, dict] = field(default_factory=dict)
    weight_variable: str | None = None

    @property
    def variable_labels(self) -> dict[str, str | None]:
        """The label of every variable, None where it has none."""
        return {n: self.labelled.get(n) for n in self.variable_names}

    @property
    def rust_variable_types(self) -> dict[str, str]:
        """Another name of variable_types."""
        return self.variable_types

    def check_var(self, name: str) -> None:
        if name not in self.variable_names:
            raise KeyError(f"variable '{name}' not found in metadata")

    def _of(self, what: dict, name: str) -> Any:
        self.check_var(name)
        return what.get(name)

    def label(self, name: str) -> str | None:
        return self._of(self.labelled, name)

    def format(self, name: str) -> str | None:
        return self._of(self.spss_variable_types, name)

    def measure(self, name: str) -> str | None:
        return self._of(self.variable_measure, name)

    def value(self, name: str) -> dict[float | str, str] | None:
        return self._of(self.variable_value_labels, name) or None

    @property
    def schema(self) -> dict[str, Any]:
        stamp = header_datetime(self.creation_time, self.modification_time)
        out = {k: getattr(self, k) for k in ("file_label", "file_format", "file_encoding")}
        out |= {"creation_time": stamp, "modification_time": stamp}
        names = (
            "number_rows", "number_columns", "weight_variable", "notes", "variable_names", "variable_labels",
            "variable_value_labels", "variable_measure", "spss_variable_types", "rust_variable_types",
            "variable_alignment", "variable_display_width", "variable_storage_width", "variable_missing", "mr_sets",
        )
        return out | {k: getattr(self, k) for k in names}

    def is_string(self, name: str) -> bool:
        return self.variable_types.get(name) == "String"

    def summary_text(self) -> str:
        n = self.number_columns
        strings = sum(map(self.is_string, self.variable_names))
        levels = {level: sum(self.variable_measure.get(v, "unknown") == level for v in self.variable_names) for level in ("nominal", "ordinal", "scale", "unknown")}
        share = lambda k: f"{100 * k / n:>5.1f}%" if n else ""
        lines = ["SPSS Metadata Summary", "═" * 42, "", "File"]
        facts = {
            "Label": self.file_label or "(none)",
            "Format": self.file_format,
            "Encoding": self.file_encoding,
            "Created": header_datetime(self.creation_time, self.modification_time),
            "Rows": "unknown" if self.number_rows is None else f"{self.number_rows:,}",
            "Columns": f"{n:,}",
            "Weight": self.weight_variable or "(none)",
        }
        if self.notes:
            note = self.notes[0].strip()
            facts["Notes"] = f"{len(self.notes)} record(s) │ {note[:40]}{'...' * (len(note) > 40)}"
        lines += [f"  {k + ':':<14}{v}" for k, v in facts.items()]
        lines += ["", "Variables", f"  {'Numeric':<14}{n - strings:>5,}    {share(n - strings)}", f"  {'String':<14}{strings:>5,}    {share(strings)}", ""]
        lines += [f"  {level.title():<14}{k:>5,}" for level, k in levels.items() if k or level != "unknown"]
        lines += ["", "Annotations"]
        for title, k in (("Labeled", len(self.labelled)), ("Value labels", len(self.variable_value_labels)), ("Missing", len(self.variable_missing))):
            lines.append(f"  {title + ':':<14}{k:>5,} / " + (f"{n:<5,}  {share(k)}" if n and k else f"{n:,}"))
        return "\n".join([*lines, f"  {'MR sets:':<14}{len(self.mr_sets):>5,}"])

    def summary(self) -> None:
        print(self.summary_text())

    def describe_text(self, names: str | list[str]) -> str:
        if isinstance(names, str):
            names = [names]
        if not isinstance(names, (list, tuple)) or not all(isinstance(x, str) for x in names):
            raise OSError("describe() expects a variable name (str) or list of names")
        for name in names:
            self.check_var(name)
        return "\n\n".join(map(self._describe, names))

    def _describe(self, name: str) -> str:
        get = lambda what: what.get(name, "?")
        specs = []
        for s in self.variable_missing.get(name, []):
            if s["type"] == "range":
                specs.append(f"{number_text(s['low'])} thru {number_text(s['high'])}")
            else:
                specs.append(f'"{s["value"]}"' if isinstance(s["value"], str) else number_text(s["value"]))
        lines = [
            f"Variable: {name}",
            f"Label:    {self.labelled.get(name, '(none)')}",
            f"Format:   {get(self.spss_variable_types):<12}Measure: {get(self.variable_measure)}",
            f"Type:     {'String' if self.is_string(name) else 'Numeric':<12}Align:   {get(self.variable_alignment)}",
            f"Display:  {get(self.variable_display_width):<12}Storage: {get(self.variable_storage_width)}",
            f"Missing:  {', '.join(specs) or '(none)'}",
        ]
        if labels := self.variable_value_labels.get(name):
            lines += ["", f"Value Labels ({len(labels)}):", *(f"  {value_text(v):<8}{text}" for v, text in labels.items())]
        return "\n".join(lines)

    def describe(self, names: str | list[str]) -> None:
        print(self.describe_text(names))

    def diff(self, other: SpssMetadata, print_output: bool = True) -> MetaDiff:
        result = compare(self, other)
        if print_output:
            result.print_summary()
        return result

    def __repr__(self) -> str:
        rows = "unknown" if self.number_rows is None else self.number_rows
        return f'SpssMetadata(columns={self.number_columns}, rows={rows}, encoding="{self.file_encoding}", compression="{self.compression}")'


_FIELDS = (
    "variable_labels", "variable_value_labels", "spss_variable_types", "variable_measure", "variable_display_width",
    "variable_storage_width", "variable_missing", "mr_sets",
)


@dataclass(frozen=True)
class MetaDiff:
    """What differs between two files' metadata; lists are in the order of the first file."""

    file_level: dict[str, tuple]
    variables_only_in_self: list[str]
    variables_only_in_other: list[str]
    variable_labels: list[dict]
    variable_value_labels: list[dict]
    spss_variable_types: list[dict]
    variable_measure: list[dict]
    variable_display_width: list[dict]
    variable_storage_width: list[dict]
    variable_missing: list[dict]
    mr_sets: list[dict]

    @property
    def is_match(self) -> bool:
        return not (self.file_level or self.variables_only_in_self or self.variables_only_in_other or any(getattr(self, f) for f in _FIELDS))

    def __getitem__(self, key: str) -> Any:
        if key not in ("is_match", "file_level", "variables_only_in_self", "variables_only_in_other", *_FIELDS):
            raise KeyError(key)
        return getattr(self, key)

    def __repr__(self) -> str:
        counted = (self.variables_only_in_self, self.variables_only_in_other, self.variable_labels, self.variable_value_labels, self.spss_variable_types)
        return f"MetaDiff(is_match={str(self.is_match).lower()}, diffs={sum(map(len, counted))})"

    def summary_text(self) -> str:
        lines = ["Metadata Diff", "============="]
        if self.file_level:
            lines += ["", "File-level:", *(f"  {k:<25}{v}" for k, v in self.file_level.items())]
        lines += ["", "Variables:"]
        for title, names in (("Only in self:", self.variables_only_in_self), ("Only in other:", self.variables_only_in_other)):
            if names:
                more = f", ... +{len(names) - 5}" if len(names) > 5 else ""
                lines.append(f"  {title:<16}{len(names):>5}   [{', '.join(names[:5])}{more}]")
        if lines[-1] == "Variables:":
            lines.append("  All variables shared")
        lines += ["", "Field diffs:"]
        for f in _FIELDS:
            n = len(getattr(self, f))
            lines.append(f"  {f:<28}{n:>3} " + ("diffs  ✓" if not n else "diff " if n == 1 else "diffs"))
        return "\n".join([*lines, "", f"Result: {'MATCH' if self.is_match else 'DIFFERENCES FOUND'}"])

    def print_summary(self) -> None:
        print(self.summary_text())


def compare(a: SpssMetadata, b: SpssMetadata) -> MetaDiff:
    shared = [n for n in a.variable_names if n in set(b.variable_names)]

    def changed(f: str, default: Any = None, attr: str | None = None) -> list[dict]:
        x, y = getattr(a, attr or f), getattr(b, attr or f)
        pairs = ((n, x.get(n, default), y.get(n, default)) for n in shared)
        return [{"variable": n, "self": p, "other": q} for n, p, q in pairs if p != q]

    labels = [(n, a.variable_value_labels.get(n, {}), b.variable_value_labels.get(n, {})) for n in shared]
    absent = [(n, n in a.variable_missing, n in b.variable_missing) for n in shared]
    return MetaDiff(
        file_level={f: (getattr(a, f), getattr(b, f)) for f in ("number_rows", "number_columns", "file_encoding", "file_label") if getattr(a, f) != getattr(b, f)},
        variables_only_in_self=sorted(set(a.variable_names) - set(b.variable_names)),
        variables_only_in_other=sorted(set(b.variable_names) - set(a.variable_names)),
        variable_labels=changed("variable_labels", "", "labelled"),
        variable_value_labels=[{"variable": n, "self_count": len(p), "other_count": len(q)} for n, p, q in labels if p != q],
        spss_variable_types=changed("spss_variable_types", ""),
        variable_measure=changed("variable_measure", "?"),
        variable_display_width=changed("variable_display_width"),
        variable_storage_width=changed("variable_storage_width"),
        variable_missing=[{"variable": n, "self_has_missing": p, "other_has_missing": q} for n, p, q in absent if p != q],
        mr_sets=[{"key": k, "status": "only_in_self"} for k in a.mr_sets if k not in b.mr_sets] + [{"key": k, "status": "only_in_other"} for k in b.mr_sets if k not in a.mr_sets],
    )
