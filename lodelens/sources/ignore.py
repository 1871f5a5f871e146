"""Which files a walk passes over: fixed lists, and ignore files with the rules of git."""

from __future__ import annotations

import re
from pathlib import Path

# Fixed values.
EXCLUDED_FOLDERS = {
    ".git", ".hg", ".svn", ".bzr", "node_modules", "bower_components", "jspm_packages", "dist", "build", "out", "target", "bin",
    "obj", "_build", ".next", ".nuxt", ".svelte-kit", ".angular", ".parcel-cache", ".venv", "venv", "env", "virtualenv",
    "__pycache__", ".mypy_cache", ".pytest_cache", ".ruff_cache", ".tox", ".gradle", ".m2", ".idea", ".vscode", ".vs", ".cache",
    "coverage", ".nyc_output", "htmlcov", "vendor", "third_party", "Pods", ".terraform", ".serverless",
}
EXCLUDED_NAMES = [
    "*.min.js", "*.min.css", "*.min.mjs", "*.map", "*.js.map", "*.css.map", "package-lock.json", "yarn.lock", "pnpm-lock.yaml",
    "npm-shrinkwrap.json", "poetry.lock", "Pipfile.lock", "Cargo.lock", "composer.lock", "go.sum", "Gemfile.lock", "*.snap",
]
BINARY_ENDS = set(
    ".png .jpg .jpeg .gif .bmp .ico .webp .tiff .svg .woff .woff2 .ttf .otf .eot .mp3 .mp4 .wav .ogg .webm .avi .mov .flac .zip .tar .gz .bz2"
    " .xz .7z .rar .pyc .pyo .so .dll .dylib .exe .bin .o .a .class .jar .wasm .pdf .doc .docx .xls .xlsx .ppt .pptx .db .sqlite .sqlite3"
    " .pack .idx .lock".split()
)


def rule(line: str) -> tuple[re.Pattern, bool, bool] | None:
    """One line of an ignore file: (pattern for a path below the file's folder, negated, folders only)."""
    text = re.sub(r"(?<!\\)\s+$", "", line.rstrip("\n"))
    if not text or text.startswith("#"):
        return None
    negated = text.startswith("!")
    text = text[1:] if negated else text
    text = text[1:] if text.startswith("\\") and text[1:2] in "#!" else text
    only_folders = text.endswith("/")
    text = text.rstrip("/")
    if not text:
        return None
    anchored = "/" in text
    text = text.lstrip("/")
    out, i = "", 0
    while i < len(text):
        if text.startswith("**/", i):
            out, i = out + "(?:[^/]+/)*", i + 3
        elif text.startswith("/**", i) and i + 3 == len(text):
            out, i = out + "/.+", i + 3
        elif text[i] == "*":
            while text[i : i + 1] == "*":
                i += 1
            out += "[^/]*"
        elif text[i] == "?":
            out, i = out + "[^/]", i + 1
        elif text[i] == "[" and text.find("]", i + 2) > 0:
            end = text.find("]", i + 2)
            body = text[i + 1 : end]
            out, i = out + "[" + ("^" + body[1:] if body[0] in "!^" else body).replace("\\", "\\\\") + "]", end + 1
        elif text[i] == "\\" and i + 1 < len(text):
            out, i = out + re.escape(text[i + 1]), i + 2
        else:
            out, i = out + re.escape(text[i]), i + 1
    return re.compile(("" if anchored else "(?:.*/)?") + out + r"\Z"), negated, only_folders


_NAMES = [rule(n) for n in EXCLUDED_NAMES]


class Ignore:
    """Built-in names, then the ignore files of every ancestor up to the root, each relative to its own folder."""

    def __init__(self, root: str | Path, use_files: bool = True):
        self.root, self.use_files, self._rules = Path(root), use_files, {}

    def _of(self, folder: Path):
        if folder not in self._rules:
            lines = []
            for name in (".gitignore", ".ignore"):
                try:
                    lines += (folder / name).read_text("utf-8", "replace").splitlines()
                except OSError:
                    pass
            self._rules[folder] = [r for r in map(rule, lines) if r]
        return self._rules[folder]

    def ignored(self, path: str | Path, folder: bool = False) -> bool:
        p = Path(path)
        if not folder and any(r[0].match(p.name) for r in _NAMES):
            return True
        if not self.use_files:
            return False
        above = p.parent
        while True:
            verdict, rel = False, p.relative_to(above).as_posix()
            for pattern, negated, only_folders in self._of(above):
                if (folder or not only_folders) and pattern.match(rel):
                    verdict = not negated
            if verdict:
                return True
            if above == self.root or above == above.parent:
                return False
            above = above.parent
