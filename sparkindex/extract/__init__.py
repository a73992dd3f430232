"""Source text to symbols and references: one tolerant scanner for each language family."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass
class Found:
    """What a scanner has found: symbols (name, qualified name, kind, first line, last
    line, signature, parent) and references (name, line)."""

    symbols: list[tuple] = field(default_factory=list)
    references: set[tuple[str, int]] = field(default_factory=set)

    def add(self, name: str, scope: tuple[str, ...], kind: str, start: int, end: int, signature: str | None) -> None:
        self.symbols.append((name, ".".join((*scope, name)), kind, start, end, signature, ".".join(scope) or None))

    def ordered(self) -> tuple[list[tuple], list[tuple[str, int]]]:
        return sorted(self.symbols, key=lambda s: (s[3], s[1])), sorted(self.references, key=lambda r: (r[1], r[0]))


def one_line(text: str) -> str:
    return " ".join(text.split())


def extract(source: bytes, language: str) -> tuple[list[tuple], list[tuple[str, int]]]:
    """Symbols and references of one file in their defined order; never fails on broken
    text. An unknown language is a ValueError."""
    from sparkindex.extract import jsscan, pyscan

    if language == "python":
        return pyscan.scan(source)
    if language in ("javascript", "typescript", "tsx"):
        return jsscan.scan(source, language)
    raise ValueError(f"unsupported language: {language}")
