"""Roles and names of files of a package."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Folders and files by their role.
TEST_FOLDERS = ["tests", "test", "__tests__", "__mocks__", "examples", "example", "docs", "doc", "e2e", "spec", "snapshot-tests", "snapshot_tests", "smoke-tests", "smoke_tests", "benchmarks"]
BUILD_FOLDERS = ["scripts", "script", "tools", ".github", ".husky"]
IGNORED_FOLDERS = ["node_modules", "bower_components", ".git", ".hg", ".svn", "__pycache__", ".venv", "venv", ".tox", ".nox", ".mypy_cache", ".pytest_cache", ".ruff_cache", ".next", ".turbo", ".cache"]
TEST_NAMES = r"^test_.*\.py\z|_test\.py\z|^conftest\.py\z|\.test\.|\.spec\.|^test-.*\.(?:js|mjs|cjs|ts|mts|cts|py)\z"
ROOT_BUILD = r"^build\.(?:[mc]?[jt]s|py)\z"
BUILD_NAMES = r"^(?:(?:webpack|rollup|vite|vitest|jest|tsup|babel|eslint|prettier)\.config|esbuild|gulpfile|Gruntfile|\.eslintrc|\.prettierrc)\.|^(?:noxfile|fabfile|hatch_build)\.py\z"
BUILD_WORDS = r"(?i)build|release|publish|deploy|bump|changelog|version|bundle|compile|lint|format|codegen|generate"


def folders(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def is_ignored(path: Column) -> Column:
    return F.exists(folders(path), lambda p: p.isin(IGNORED_FOLDERS))


def in_test_folder(path: Column) -> Column:
    return F.exists(folders(path), lambda p: F.lower(p).isin(TEST_FOLDERS))


def location_kind(path: Column) -> Column:
    """test_or_example, build_script or server_code, in this order; folders in any case, file names as they are."""
    name = file_name(path)
    test = in_test_folder(path) | name.rlike(TEST_NAMES)
    first = F.split_part(path, F.lit("/"), F.lit(1))
    in_build = F.exists(folders(path), lambda p: F.lower(p).isin(BUILD_FOLDERS)) & name.rlike(BUILD_WORDS)
    build = (F.contains(path, F.lit("/")) & (F.lower(first) == ".github")) | path.rlike(ROOT_BUILD) | name.rlike(BUILD_NAMES) | in_build
    return F.when(test, "test_or_example").when(build, "build_script").otherwise("server_code")


def safe_entry(name: Column) -> Column:
    """An archive entry's name without NUL, backslash, drive, absolute start or a parent step."""
    odd = name.rlike(r"\x00|\\|^/|^[A-Za-z]:") | F.array_contains(F.split(name, "/"), "..")
    return F.coalesce(~odd & (F.length(name) > 0), F.lit(False))


def inside(path: Column, folder: Column) -> Column:
    return (folder == ".") | (path == folder) | F.startswith(path, F.concat(folder, F.lit("/")))


def relative_to(path: Column, folder: Column) -> Column:
    return F.when((folder != ".") & F.startswith(path, F.concat(folder, F.lit("/"))), F.substr(path, F.length(folder) + 2)).otherwise(path)


def binary_signature(head: Column) -> Column:
    """elf, mach_o, wasm or pe by the first bytes; a PE file names the place of its own signature at byte 60."""
    h = F.hex(F.substring(head, 1, 4))
    at = F.conv(F.concat(*[F.hex(F.substring(head, i, 1)) for i in (64, 63, 62, 61)]), 16, 10).cast("int")
    pe = (F.substring(h, 1, 4) == "4D5A") & (F.hex(F.substr(head, at + 1, F.lit(4))) == "50450000")
    mach = h.isin("FEEDFACE", "FEEDFACF", "CEFAEDFE", "CFFAEDFE", "CAFEBABE")
    return F.when(h == "7F454C46", "elf").when(mach, "mach_o").when(h == "0061736D", "wasm").when(pe, "pe")


def is_pure_wheel(name: Column) -> Column:
    """A wheel for any platform and no binary interface."""
    parts = F.split(F.regexp_replace(name, r"\.whl\z", ""), "-")
    return F.endswith(name, F.lit(".whl")) & (F.element_at(parts, -1) == "any") & (F.element_at(parts, -2) == "none")
