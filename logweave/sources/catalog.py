"""Discovery on the driver: which files there are, how to read them, and why others are left out."""

import fnmatch
import os
import re
from collections import Counter
from dataclasses import dataclass, field
from datetime import datetime

from ..functions.fixed import MAX_FILES

# Suffixes by reader, and how much of a file is looked at.
COMPRESSED = {".gz": "gzip", ".bz2": "bzip2", ".xz": "xz", ".lzma": "xz"}
DOCUMENTS = {".ods": "ods"}
HEAD = 8192
BOMS = ((b"\xff\xfe\x00\x00", "utf-32-le"), (b"\x00\x00\xfe\xff", "utf-32-be"), (b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be"))


def encoding(head: bytes):
    """(name, length of the mark) by byte order mark, else UTF-8."""
    return next(((name, len(mark)) for mark, name in BOMS if head.startswith(mark)), ("utf-8", 0))


def looks_binary(head: bytes) -> bool:
    """Whether the decoded head holds a NUL character."""
    name, skip = encoding(head)
    return "\0" in head[skip:HEAD].decode(name, "ignore")


@dataclass(frozen=True)
class File:
    path: str
    root: str
    kind: str  # text, gzip, bzip2, xz or ods
    encoding: str = "utf-8"
    set_base: str | None = None
    member_rank: tuple = (0, 0)


@dataclass
class Report:
    files: list = field(default_factory=list)
    skipped: Counter = field(default_factory=Counter)
    truncated: list = field(default_factory=list)
    missing: list = field(default_factory=list)
    damaged: list = field(default_factory=list)
    partial: list = field(default_factory=list)  # rotated logs that lack a damaged member

    def extend(self, other: "Report") -> None:
        known = {f.path for f in self.files}
        self.files += [f for f in other.files if f.path not in known]
        self.skipped += other.skipped
        self.truncated += other.truncated
        self.missing += other.missing
        self.damaged += other.damaged
        self.partial += other.partial

    def leave_out(self, damaged) -> None:
        """Takes damaged files out; rotated logs that they belonged to are partial from then on."""
        gone = set(damaged)
        sets, _ = group_rotated(self.files)
        self.partial += [base for base, members in sets.items() if any(m.path in gone for m in members)]
        self.files = [f for f in self.files if f.path not in gone]
        self.damaged += sorted(gone)
        self.skipped["damaged"] += len(gone)

    def summary(self):
        out = [f"{len(self.files)} files"] + [f"{n} skipped: {why}" for why, n in sorted(self.skipped.items())]
        return out + [f"{r}: only the first files" for r in self.truncated] + [f"{r}: a member is damaged" for r in self.partial] + [f"{r}: not there" for r in self.missing]


def matched_glob(path: str, root: str, globs):
    """The first glob that fits a file's name, its path below the root, or its whole path."""
    names = (os.path.basename(path), os.path.relpath(path, root), path)
    return next((g for g in globs if any(fnmatch.fnmatchcase(n, g) for n in names)), None)


def walk(root: str):
    """Files below a folder, folders and files by name without case; a link back to an open folder is not followed."""
    seen = set()

    def into(folder):
        real = os.path.realpath(folder)
        if real in seen:
            return
        seen.add(real)
        try:
            items = sorted(os.scandir(folder), key=lambda e: (e.name.lower(), e.name))
        except OSError:
            return
        for e in items:
            if e.is_file():
                yield e.path
        for e in items:
            if e.is_dir():
                yield from into(e.path)

    return into(root)


def classify(path: str):
    """(File or None, reason)."""
    suffix = os.path.splitext(path)[1].lower()
    if suffix in DOCUMENTS:
        return File(path, "", DOCUMENTS[suffix]), None
    try:
        with open(path, "rb") as f:
            head = f.read(HEAD)
    except OSError:
        return None, "unreadable"
    if suffix in COMPRESSED:
        return probe(path, COMPRESSED[suffix])
    if looks_binary(head):
        return None, "binary"
    return File(path, "", "text", encoding(head)[0]), None


def probe(path: str, kind: str):
    """Whether a compressed file opens and holds text, from its first bytes."""
    import bz2
    import gzip
    import lzma

    try:
        with {"gzip": gzip, "bzip2": bz2, "xz": lzma}[kind].open(path, "rb") as f:
            head = f.read(HEAD)
    except (OSError, EOFError, lzma.LZMAError, ValueError):
        return None, "damaged"
    return (None, "binary") if looks_binary(head) else (File(path, "", kind, encoding(head)[0]), None)


def discover(roots, include=(), exclude=None, max_files: int = MAX_FILES, unsupported=("*.pdf", "*.zip", "*.tar", "*.png", "*.jpg")) -> Report:
    """Files below the roots.  A root that is a file is taken whatever the caller's globs say, but not of any type.

    exclude: None for the unsupported types alone, () for no globs at all.
    """
    report = Report()
    types = () if exclude == () else tuple(unsupported)
    for root in roots:
        root = os.path.abspath(root)
        named = os.path.isfile(root)
        if not named and not os.path.isdir(root):
            report.missing.append(root)
            continue
        kept = 0
        for path in [root] if named else walk(root):
            base = os.path.dirname(root) if named else root
            if matched_glob(path, base, types):
                report.skipped["unsupported"] += 1
            elif not named and (include and not matched_glob(path, base, include) or matched_glob(path, base, exclude or ())):
                report.skipped["filtered"] += 1
            elif kept >= max_files:
                report.truncated.append(root)
                break
            else:
                found, why = classify(path)
                if found:
                    report.files.append(File(path, base, found.kind, found.encoding))
                    kept += 1
                else:
                    report.skipped[why] += 1
    report.files = sorted({f.path: f for f in report.files}.values(), key=lambda f: f.path.lower())
    return report


@dataclass(frozen=True)
class Host:
    """What differs on one machine; None takes the general value, an empty tuple means no globs at all."""

    include: tuple | None = None
    exclude: tuple | None = None
    max_files: int | None = None
    budget: int | None = None


def node_of(path: str) -> str:
    """The machine that a path names, as in /logs/node=web1/app.log; "" for this one."""
    found = re.search(r"(?:^|/)node=([^/]+)(?:/|$)", path)
    return found[1] if found else ""


def discover_hosts(roots, hosts, **how) -> Report:
    """discover, each root under the settings of the machine that its path names."""
    report = Report()
    for root in roots:
        host = hosts.get(node_of(os.path.abspath(root)), Host())
        own = {k: v for k in ("include", "exclude", "max_files") if (v := getattr(host, k)) is not None}
        report.extend(discover([root], **{**how, **own}))
    report.files.sort(key=lambda f: f.path.lower())
    return report


def check_access(path: str):
    """None if a file can be opened or a folder listed, else why not; both are tried and not read off the mode."""
    try:
        if os.path.isdir(path):
            os.scandir(path).close()
        else:
            open(path, "rb").close()
    except OSError as e:
        return f"{path}: {e.strerror or 'cannot be read'}"
    return None


def toggled(members, path: str) -> tuple:
    """A merged set with a source taken in, or out if it is there; links to one file are one source; sorted."""
    key = os.path.realpath(path)
    return tuple(sorted(set(members) ^ {key}))


def rotation(path: str):
    """(log that a file belongs to, rank), newest first; None where the name says nothing.

    A dot and eight digits that form a date are a date, not a number: later is newer.
    """
    stem, suffix = os.path.splitext(path)
    packed = suffix.lower() in COMPRESSED
    name = stem if packed else path
    if m := re.fullmatch(r"(.+?)[.\-](\d{8}|\d{4}-\d{2}-\d{2})", name, re.S):
        digits = m[2].replace("-", "")
        try:
            datetime.strptime(digits, "%Y%m%d")
            return m[1], (2, -int(digits))
        except ValueError:
            pass
    if m := re.fullmatch(r"(.+)\.(\d+)", name, re.S):
        return m[1], (1, int(m[2]))
    return (name, (1, 0)) if packed else None


def group_rotated(files):
    """(sets {base: members newest first}, single files); a set has two members or more."""
    sets = {}
    for f in files:
        base, rank = rotation(f.path) or (f.path, (0, 0))
        sets.setdefault(base, []).append((rank, f))
    whole = {b: [File(f.path, f.root, f.kind, f.encoding, b, r) for r, f in sorted(m, key=lambda x: (x[0], x[1].path))] for b, m in sets.items() if len(m) > 1}
    return whole, [f for m in sets.values() if len(m) == 1 for _, f in m]
