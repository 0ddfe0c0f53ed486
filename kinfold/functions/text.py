"""Small formats that are read on the driver: percent codes, file types, trees, pedigrees, regions."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

_HEX2 = re.compile("%([0-9A-Fa-f]{2})|%.?.?", re.S)


def percent_decode(text: str) -> str:
    """%XX is the byte XX; a percent sign with anything else after it goes, with its two characters."""

    def turn(m: re.Match) -> bytes:
        return bytes([int(m[1], 16)]) if m[1] else b""

    raw, at, out = text, 0, b""
    for m in _HEX2.finditer(raw):
        out += raw[at : m.start()].encode() + turn(m)
        at = m.end()
    return (out + raw[at:].encode()).decode("utf-8", "replace")


_PACKED = ("gz", "gzip", "bgz")


def file_type(path: str) -> tuple[str, str, str]:
    """(path, extension, compression); `ext:path` tells the type whatever the name is."""
    path = path.strip()
    m = re.match(r"([^:/.]+(?:\.(?:gz|gzip|bgz))?):(.*)$", path, re.S)
    told, rest = (m[1], m[2]) if m else (None, path)
    name = told if told is not None else rest.rsplit("/", 1)[-1]
    parts = name.split(".")
    if told is None:
        parts = parts[1:] if parts[0] else parts[2:]
    packed = parts.pop() if len(parts) > 0 and parts[-1].lower() in _PACKED else ""
    return rest, parts[-1] if parts else "", packed


_CATEGORIES = {"bam": "sequence", "sam": "sequence", "cram": "sequence", "bcf": "variant", "vcf": "variant", "ped": "pedigree"}


def file_category(extension: str, allowed: tuple[str, ...] = ("sequence", "variant", "pedigree")) -> str:
    found = _CATEGORIES.get(extension.lower())
    if found not in allowed:
        raise ValueError(f"file type '{extension}' is not supported")
    return found


def input_mode(paths: list[str]) -> str:
    """The one category of all inputs; mixtures are refused."""
    kinds = {file_category(file_type(p)[1], ("sequence", "variant")) for p in paths}
    if len(kinds) != 1:
        raise ValueError("inputs must be all sequences or all variants")
    return kinds.pop()


def _by_prefix(text: str, names: list[tuple[str, str]], what: str) -> str:
    low = text.strip().lower()
    if low:
        for name, value in names:
            if name.startswith(low):
                return value
    raise ValueError(f"{what} '{text}' is not known")


def parse_sex(text: str) -> str:
    return _by_prefix(text, [("0", "autosomal"), ("1", "male"), ("2", "female"), ("male", "male"), ("female", "female"), ("autosomal", "autosomal")], "sex")


def parse_inheritance(text: str) -> str:
    names = [("autosomal", "autosomal"), ("maternal", "maternal"), ("paternal", "paternal")]
    names += [(f"{c}{tail}", f"{c}-linked") for c in "xywz" for tail in ("-linked", "linked")]
    names += [("mitochondrial", "maternal"), ("m-linked", "maternal"), ("p-linked", "paternal")]
    return _by_prefix(text, names, "inheritance model")


@dataclass
class Twig:
    """A node of a rooted tree, its length to the parent included."""

    label: str = ""
    length: float = 1.0
    children: list[Twig] = field(default_factory=list)

    def walk(self):
        """Parents first."""
        yield self
        for c in self.children:
            yield from c.walk()

    def leaves(self) -> list[str]:
        return [t.label for t in self.walk() if not t.children]


_TOKEN = re.compile(r"\s*([(),:;]|'(?:[^']|'')*'|[^\s(),:;']+)")


def parse_newick(text: str) -> Twig:
    """Lengths default to 1; all of the text must be a tree, a closing semicolon may be left out."""
    tokens, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"not a tree: {text!r}")
        tokens.append(m[1])
        at = m.end()
    if tokens and tokens[-1] == ";":
        tokens.pop()
    pos = 0

    def peek() -> str:
        return tokens[pos] if pos < len(tokens) else ""

    def take(want: str = "") -> str:
        nonlocal pos
        if pos >= len(tokens) or (want and tokens[pos] != want):
            raise ValueError(f"not a tree: {text!r}")
        pos += 1
        return tokens[pos - 1]

    def node() -> Twig:
        t = Twig()
        if peek() == "(":
            take("(")
            t.children.append(node())
            while peek() == ",":
                take(",")
                t.children.append(node())
            take(")")
        if peek() and peek() not in "(),:;":
            word = take()
            t.label = word[1:-1].replace("''", "'") if word[0] == "'" else word
        elif not t.children:
            raise ValueError(f"a tip without a name: {text!r}")
        if peek() == ":":
            take(":")
            t.length = float(take())
        return t

    tree = node()
    if pos != len(tokens):
        raise ValueError(f"not a tree: {text!r}")
    return tree


def write_newick(t: Twig, lengths: bool = True) -> str:
    def one(n: Twig) -> str:
        inner = f"({','.join(map(one, n.children))})" if n.children else ""
        return inner + n.label + (f":{n.length:g}" if lengths else "")

    return one(t) + ";"


@dataclass(frozen=True)
class Member:
    name: str
    dad: str | None
    mom: str | None
    sex: str
    samples: tuple[str, ...] = ()
    tags: tuple[str, ...] = ()
    dad_length: float = 1.0
    mom_length: float = 1.0


def parse_pedigree(text: str) -> list[Member]:
    """Rows `name@tag... dad[:length] mom[:length] sex sample...` below the mark ##PEDNG; `.` is none, `=` the own name."""
    lines = text.splitlines()
    if not lines or (lines[0].split() or [""])[0] != "##PEDNG":
        raise ValueError("a pedigree begins with ##PEDNG")
    out: list[Member] = []
    for number, line in enumerate(lines[1:], 2):
        cells = line.split()
        if not cells or cells[0].startswith("#"):
            continue
        if len(cells) < 5:
            raise ValueError(f"row {number} has {len(cells)} columns instead of 5 or more")
        names = [n for n in cells[0].split("@") if n]
        if cells[0].startswith("@") or not names:
            raise ValueError(f"row {number} has an empty name")
        parents = []
        for cell in cells[1:3]:
            name, colon, length = cell.partition(":")
            if not name:
                raise ValueError(f"row {number} has an empty parent")
            if name == ".":
                parents.append((None, 1.0))
                continue
            try:
                parents.append((percent_decode(name), float(length) if colon else 1.0))
            except ValueError:
                raise ValueError(f"row {number} has an invalid length") from None
        try:
            sex = parse_sex(cells[3])
        except ValueError:
            raise ValueError(f"row {number} has an invalid sex") from None
        name = percent_decode(names[0])
        samples = tuple(name if s == "=" else s for s in cells[4:] if s != ".")
        out.append(Member(name, parents[0][0], parents[1][0], sex, samples, tuple(map(percent_decode, names[1:])), parents[0][1], parents[1][1]))
    if len({m.name for m in out}) != len(out):
        raise ValueError("a name occurs twice")
    return out


_NUMBER = r"\d+(?:\.\d*)?[eE][+-]?\d+|\d+\.\d*|\d{1,3}(?:,\d{3})+|\d+"
_REGION = re.compile(rf"\s*([^\s:*=][^\s:]*)\s*(?::\s*(?:({_NUMBER})\s*(?:(-)\s*({_NUMBER})?|\+\s*({_NUMBER}))?|-\s*({_NUMBER})))?(?=\s|$)")


def parse_regions(text: str) -> list[tuple[str, int | None, int | None]]:
    """(contig, first, last), 1-based, closed; None where open. `c`, `c:p`, `c:a-b`, `c:a-`, `c:-b`, `c:a+length`."""
    whole = lambda s: int(float(s.replace(",", "")))
    out, at = [], 0
    while at < len(text.rstrip()):
        m = _REGION.match(text, at)
        if not m:
            raise ValueError(f"not a region: {text[at:]!r}")
        name, first, dash, last, length, until = m.groups()
        if until:
            out.append((name, 1, whole(until)))
        elif first is None:
            out.append((name, None, None))
        elif length:
            out.append((name, whole(first), whole(first) + whole(length) - 1))
        else:
            out.append((name, whole(first), whole(last) if last else (None if dash else whole(first))))
        at = m.end()
    if not out:
        raise ValueError("no region")
    return out


def region_ranges(regions: list[tuple[str, int | None, int | None]], contigs: dict[str, int]) -> list[tuple[int, int, int]]:
    """(number of the contig, beg, end), 0-based, half-open, within the contig's length."""
    order = {c: i for i, c in enumerate(contigs)}
    out = []
    for name, first, last in regions:
        if name not in order:
            raise ValueError(f"contig '{name}' is not known")
        beg, end = max(0, (first or 1) - 1), min(contigs[name], contigs[name] if last is None else last)
        if beg >= end:
            raise ValueError(f"region of '{name}' is empty")
        out.append((order[name], beg, end))
    return out


_CIGAR = re.compile(r"(\d+)([MIDNSHP=X])")


def cigar_runs(cigar: str) -> list[tuple[int, str]]:
    return [(int(n), op) for n, op in _CIGAR.findall(cigar)]


def query_length(cigar: str) -> int:
    return sum(n for n, op in cigar_runs(cigar) if op in "MIS=X")


def target_length(cigar: str) -> int:
    return sum(n for n, op in cigar_runs(cigar) if op in "MDN=X")


def query_position(cigar: str, offset: int) -> tuple[int, bool]:
    """Position in the read of a place `offset` bases right of the alignment's start, and if the place is deleted.

    Before the start -1; beyond the end the read's length.
    """
    if offset < 0:
        return -1, False
    query = 0
    for n, op in cigar_runs(cigar):
        if op in "M=X":
            if offset < n:
                return query + offset, False
            query, offset = query + n, offset - n
        elif op in "DN":
            if offset < n:
                return query, True
            offset -= n
        elif op in "IS":
            query += n
    return query, False


def indel_length(ref: str, alt: str) -> int:
    return abs(len(ref) - len(alt))


def parse_numbers(text: str, separators: str = ",", whole: bool = False) -> list:
    """Numbers between any of the separators; blanks around them don't count, an empty text has none."""
    parts = [x.strip() for x in re.split(f"[{re.escape(separators)}]", text)] if text.strip() else []
    try:
        return [int(x) if whole else float(x) for x in parts]
    except ValueError:
        raise ValueError(f"not a list of numbers: {text!r}") from None


def base_frequencies(text: str) -> list[float]:
    """Shares of A, C, G, T, made to sum to 1."""
    own = parse_numbers(text)
    if len(own) != 4 or min(own) < 0 or not 0 < sum(own) < float("inf"):
        raise ValueError(f"four frequencies are needed, none of them negative: {text!r}")
    return [x / sum(own) for x in own]


def told_by_file(text: str) -> tuple[str, str]:
    """An option's text, and "" ; of `@file` or `@ext:file` what the file holds, and its extension."""
    if not text.startswith("@"):
        return text, ""
    path, extension, _ = file_type(text[1:])
    with open(path, encoding="utf-8") as f:
        return f.read(), extension
