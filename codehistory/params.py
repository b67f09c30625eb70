"""Parameters that shape every number."""

from __future__ import annotations

from dataclasses import dataclass

# Names of authors that are automation, as globs on the lower-cased author.
IGNORE_AUTHORS = ("root", "*bot*", "*agent*", "*pipelines*", "*jenkins*", "*noreply*", "system administrator", "releng-*")

# Generated files, as globs on the path; * crosses /.
EXCLUDE = (
    "*.lock", "*.lockfile", "*-lock.json", "*.sum", "*.min.js", "*.map", "*.snap", "*/dist/*", "*/build/*", "*/generated/*",
    "*/vendor/*", "*/node_modules/*", "dist/*", "build/*", "generated/*", "vendor/*", "node_modules/*",
)


@dataclass(frozen=True)
class Params:
    """months: window; max_files: most files of a commit that still couples them; exclude and ignore_authors: globs, empty for no filter."""

    months: int = 12
    max_files: int = 30
    max_regions: int = 40
    exclude: tuple[str, ...] = EXCLUDE
    ignore_authors: tuple[str, ...] = IGNORE_AUTHORS
    min_lines: int = 50
    young_days: int = 30
    ownership_floor: float = 0.6
    ownership_days: int = 3
    top: int = 6
