"""The options of a duplicate search: one frozen record in place of a query text."""

from __future__ import annotations

import argparse
from dataclasses import dataclass

from .functions.sizes import parse_size
from .functions.vectors import level
from .operators.rules import java_regex

#: The largest number of workers, and names of archives.
MOST_THREADS = 256
HASHES = ("md5", "sha256", "xxh128")
ARCHIVES = r"^.*\.(tar\.gz|tgz|tar\.bz2|tbz2|tar\.xz|txz|zip|rar|7z|tar)$"
IMAGES = r".*\.(gif|png|jpe?g)$"


@dataclass(frozen=True)
class Options:
    roots: tuple[str, ...] = ()
    hidden: bool = False
    ignore_case: bool = False
    show_size: bool = False
    dry_run: bool = False
    ignore_regex: str | None = None
    whitelist_regex: str | None = None
    follow_links: bool = False
    images: bool = False
    threshold: float = level(1)
    deny: tuple[str, ...] = (".", "..")
    json: bool = False
    min_size: int = 0
    max_size: int = 0
    priority: str | None = None
    recurse: bool = True
    separator: str = "\n"
    archives: bool = False
    threads: int | None = None
    verbose: bool = False
    strict_whitelist: bool = False
    strict_ignore: bool = False
    dedupe_paths: bool = False
    hash_kind: str = "md5"
    verify: bool = False

    def __post_init__(self):
        if self.threads is not None and not 1 <= self.threads <= MOST_THREADS:
            raise ValueError(f"threads: {self.threads} is not from 1 to {MOST_THREADS}")
        if self.hash_kind not in HASHES:
            raise ValueError(f"hash {self.hash_kind}: {', '.join(HASHES)} are known")
        for name in ("ignore_regex", "whitelist_regex"):
            if (pattern := getattr(self, name)) is not None:
                java_regex(pattern, self.ignore_case)

    @classmethod
    def parse(cls, argv: list[str]) -> Options:
        """From command-line words. Raises ValueError for a bad option and where no root is given."""
        p = argparse.ArgumentParser(prog="dupspark", exit_on_error=False, add_help=False)
        for short, long, name in (("-a", "--hidden", "hidden"), ("-c", "--case-unsensitive", "ignore_case"), ("-d", "--display-size", "show_size"), ("-n", "--dry-run", "dry_run"), ("-f", "--follow-symlink", "follow_links"), ("-I", "--image-cmp", "images"), ("-J", "--json", "json"), ("-t", "--tar-cmp", "archives"), ("-v", "--verbose", "verbose"), ("-o", "--optimize-memory", "_unused")):
            p.add_argument(short, long, dest=name, action="store_true")
        for name in ("verify", "strict_whitelist", "strict_ignore", "dedupe_paths"):
            p.add_argument(f"--{name.replace('_', '-')}", dest=name, action="store_true")
        p.add_argument("--hash", dest="hash_kind", default="md5")
        p.add_argument("-r", "--recurse-subdir", dest="recurse", action="store_true", default=True)
        p.add_argument("-R", "--no-recurse", dest="recurse", action="store_false")
        for short, long, name in (("-e", "--regex-ignore-file", "ignore_regex"), ("-w", "--whitelist-regex-file", "whitelist_regex"), ("-T", "--image-threshold", "_level"), ("-i", "--ignore-list", "_deny"), ("-m", "--minimal-length", "_min"), ("-M", "--max-size", "_max"), ("-p", "--priority-path", "priority"), ("-s", "--separator", "_sep"), ("-j", "--threads", "_threads"), ("-x", "--excessive-size", "_excess")):
            p.add_argument(short, long, dest=name)
        p.add_argument("roots", nargs="*")
        try:
            a, rest = p.parse_known_args(argv)
        except (argparse.ArgumentError, SystemExit) as e:
            raise ValueError(str(e)) from e
        if rest:
            raise ValueError(f"unknown option {rest[0]}")
        if not a.roots:
            raise ValueError("no input: name at least one file or directory")
        sizes = {}
        for name in ("_min", "_max", "_excess"):
            if (text := getattr(a, name)) is not None and (sizes.setdefault(name, parse_size(text))) < 0:
                raise ValueError(f"bad size {text}")
        if a._threads is not None and not a._threads.lstrip("-").isdigit():
            raise ValueError(f"bad number of threads {a._threads}")
        if a._level is not None and not a._level.isdigit():
            raise ValueError(f"bad similarity level {a._level}")
        return cls(
            tuple(a.roots), a.hidden, a.ignore_case or a.images, a.show_size, a.dry_run, a.ignore_regex, IMAGES if a.images else a.whitelist_regex, a.follow_links, a.images,
            level(int(a._level)) if a._level else level(1), (".", "..", *(a._deny.split(",") if a._deny else ())), a.json, sizes.get("_min", 0), sizes.get("_max", 0), a.priority, a.recurse,
            a._sep[0] if a._sep else "\n", a.archives, int(a._threads) if a._threads else None, a.verbose and not a.json, a.strict_whitelist, a.strict_ignore, a.dedupe_paths, a.hash_kind, a.verify,
        )
