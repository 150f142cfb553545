"""Languages of source files by extension or file name."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The languages that are indexed, with their file extensions.
EXTENSIONS: dict[str, str] = {
    "java": "java",
    "groovy": "groovy gradle",
    "kotlin": "kt kts",
    "scala": "scala sc",
    "clojure": "clj cljs cljc edn",
    "javascript": "js mjs cjs jsx vue svelte",
    "typescript": "ts tsx",
    "html": "html htm xhtml",
    "css": "css scss sass less",
    "c": "c h",
    "cpp": "cpp cc cxx hpp hh hxx",
    "csharp": "cs csx",
    "objc": "m mm",
    "rust": "rs",
    "go": "go",
    "swift": "swift",
    "zig": "zig",
    "d": "d",
    "python": "py pyw pyi",
    "ruby": "rb rake gemspec",
    "perl": "pl pm t",
    "php": "php phtml",
    "lua": "lua",
    "r": "r",
    "julia": "jl",
    "tcl": "tcl",
    "haskell": "hs lhs",
    "ocaml": "ml mli",
    "fsharp": "fs fsi fsx",
    "elixir": "ex exs",
    "erlang": "erl hrl",
    "lisp": "lisp lsp cl el",
    "scheme": "scm ss",
    "racket": "rkt",
    "dart": "dart",
    "fortran": "f f90 f95 f03 f08 for",
    "pascal": "pas pp",
    "ada": "ada adb ads",
    "asm": "asm s",
    "vbnet": "vb vbs",
    "markdown": "md markdown mdx",
    "text": "txt",
    "rst": "rst",
    "asciidoc": "adoc asciidoc",
    "latex": "tex",
    "sql": "sql",
    "xml": "xml xsd xsl xslt",
    "json": "json jsonc json5",
    "yaml": "yml yaml",
    "toml": "toml",
    "ini": "ini cfg conf properties env",
    "shell": "sh bash zsh fish",
    "powershell": "ps1 psm1 psd1",
    "batch": "bat cmd",
    "makefile": "mk mak",
    "cmake": "cmake",
    "protobuf": "proto",
    "graphql": "graphql gql",
    "thrift": "thrift",
}
# File names, case-sensitive, that are looked up when the extension is unknown.
FILE_NAMES: dict[str, str] = {
    "Makefile": "makefile",
    "makefile": "makefile",
    "GNUmakefile": "makefile",
    "Dockerfile": "dockerfile",
    "Jenkinsfile": "groovy",
    "Vagrantfile": "ruby",
    "Rakefile": "ruby",
    "Gemfile": "ruby",
    "CMakeLists.txt": "cmake",
}
BY_EXTENSION = {extension: language for language, extensions in EXTENSIONS.items() for extension in extensions.split()}


def extension_of(name: str) -> str:
    """What follows the last dot, in lower case; empty without a dot or after a trailing one."""
    return name.rpartition(".")[2].lower() if "." in name else ""


def language_of(path: str) -> str | None:
    """None for a file that is not indexed."""
    name = path.replace("\\", "/").rpartition("/")[2]
    return BY_EXTENSION.get(extension_of(name)) or FILE_NAMES.get(name)


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(file_name(path), r"\.([^.]+)$", 1))


def language(path: Column) -> Column:
    """The language as an expression: a lookup in literal maps, null for files that are not indexed."""
    by_extension = F.create_map(*[F.lit(x) for pair in BY_EXTENSION.items() for x in pair])
    by_name = F.create_map(*[F.lit(x) for pair in FILE_NAMES.items() for x in pair])
    return F.coalesce(F.try_element_at(by_extension, extension(path)), F.try_element_at(by_name, file_name(path)))


def is_binary(content: Column, head: int = 8192) -> Column:
    """A zero byte among the first ``head`` bytes."""
    return F.contains(F.substring(content, 1, head), F.unhex(F.lit("00")))


def as_text(content: Column) -> Column:
    """Bytes as UTF-8, with U+FFFD for what is malformed."""
    return F.make_valid_utf8(content.cast("string"))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))
