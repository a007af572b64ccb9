"""Settings with defaults; a TOML file overrides them key by key."""
from __future__ import annotations

import tomllib
from dataclasses import dataclass, field, fields, is_dataclass
from pathlib import Path

#: directories that a walk never enters, and those whose changes a watcher drops
IGNORED_DIRS = sorted("var temp tmp log logs target vendor dist build coverage htmlcov node_modules __pycache__ cache .svn .git".split())
WATCH_IGNORED_DIRS = sorted("tmp logs __pycache__ .git cache build dist target vendor node_modules".split())

_FOLDERS = """.cache .coverage .git .hg .idea .mypy_cache .nyc_output .phpunit.cache .pytest_cache .ruff_cache .svn .tmp .venv .vs .vscode
 __pycache__ _build bin bower_components build cache caches coverage dist htmlcov log logs node_modules obj out target temp tmp var/cache vendor venv"""
_ENDINGS = """7z avi bmp bundle.js chunk.js class db dll doc docx dylib eot exe gif gz ico jpeg jpg log map min.css min.js mov mp3 mp4
 o ogg otf pdf png ppt pptx psd pyc pyo rar so sqlite sqlite3 svg swo swp tar tiff ttf wav webm webp woff woff2 xls xlsx zip"""
_LOCKS = "Cargo.lock Gemfile.lock composer.lock package-lock.json pnpm-lock.yaml poetry.lock yarn.lock"
IGNORE_PATTERNS = [f"**/{d}/**" for d in _FOLDERS.split()] + [f"**/*.{e}" for e in _ENDINGS.split()] + _LOCKS.split()

TEXT_EXTENSIONS = frozenset("""
 astro avsc bash bat blade c cc cfg cjs clj cmake cmd conf cpp cs css csv cts dockerfile editorconfig ejs env erb erl eta ex exs fish fs
 gitattributes gitignore go gql gradle graphql h haml handlebars hbs hcl hh hpp hs htm html ini jade java jinja jinja2 jl js json jsx kt
 less liquid lua makefile markdown md mjs ml mts mustache nix njk nunjucks php pl pm pom proto ps1 pug py r rb rs rst sass scala scss sh
 sql svelte swift tf thrift toml ts tsx twig txt vue xml yaml yml zsh""".split())
TEXT_NAMES = frozenset("authors changelog contributing copying dockerfile gemfile license makefile procfile rakefile readme todo".split())


@dataclass
class IndexerConfig:
    data_dir: str = str(Path.home() / ".local/share/quillon")
    max_file_size: int = 10 * 1024 * 1024
    chunk_size: int = 50
    chunk_overlap: int = 10
    follow_symlinks: bool = True
    respect_gitignore: bool = False
    embed_chunks: bool = False
    include_extensions: list = field(default_factory=list)
    ignore_patterns: list = field(default_factory=lambda: list(IGNORE_PATTERNS))


@dataclass
class SearchConfig:
    default_limit: int = 10
    max_limit: int = 100
    bm25_weight: float = 0.5
    vector_weight: float = 0.5


@dataclass
class Config:
    indexer: IndexerConfig = field(default_factory=IndexerConfig)
    search: SearchConfig = field(default_factory=SearchConfig)

    @classmethod
    def load(cls, *paths) -> Config:
        """The first of the paths that can be read and parsed wins; else the defaults."""
        for p in paths:
            try:
                return cls.load_from(p)
            except (OSError, tomllib.TOMLDecodeError):
                continue
        return cls()

    @classmethod
    def load_from(cls, path) -> Config:
        def fill(obj, data):
            for f in fields(obj):
                if f.name in data:
                    now = getattr(obj, f.name)
                    if is_dataclass(now):
                        fill(now, data[f.name])
                    else:
                        setattr(obj, f.name, data[f.name])
            return obj
        return fill(cls(), tomllib.loads(Path(path).read_text()))
