"""Lookup values shared by the operators."""

from __future__ import annotations

# File extension -> language. Matching is case-sensitive.
EXTENSION_LANGUAGE = {
    ".py": "python",
    ".js": "javascript",
    ".ts": "typescript",
    ".go": "go",
    ".java": "java",
    ".rs": "rust",
    ".c": "c",
    ".h": "c",
    ".cpp": "cpp",
    ".hpp": "cpp",
    ".cs": "c-sharp",
    ".rb": "ruby",
    ".kt": "kotlin",
    ".swift": "swift",
    ".php": "php",
    ".dart": "dart",
    ".t": "perl",
    ".lua": "lua",
    ".R": "r",
    ".exs": "elixir",
    ".ex": "elixir",
    ".erl": "erlang",
    ".hs": "haskell",
    ".scala": "scala",
    ".bats": "bash",
    ".sh": "bash",
}

# Directory names never searched for source files.
SKIP_DIRS = [
    "__pycache__", "venv", "env", "htmlcov", "site-packages", "eggs", "wheels",
    "node_modules", "bower_components", "dist", "out", "build", "coverage",
    "vendor", "bundle",
    "target", "bin",
    "obj", "Debug", "Release", "cmake-build-debug", "cmake-build-release",
    "Carthage", "Pods", "DerivedData",
    "tool",
    "blib", "lua_modules",
    "_build", "deps", "dist-newstyle",
]

# Language -> suffix of a generated test file.
TEST_SUFFIX = {
    "python": ".py",
    "javascript": ".test.js",
    "typescript": ".test.ts",
    "go": "_test.go",
    "java": "Test.java",
    "ruby": "_spec.rb",
    "rust": ".rs",
    "c": ".c",
    "cpp": ".cpp",
    "c-sharp": "Tests.cs",
    "kotlin": "Test.kt",
    "swift": "Tests.swift",
    "php": "Test.php",
    "dart": "_test.dart",
    "perl": ".t",
    "lua": "_spec.lua",
    "r": "test.R",
    "elixir": "_test.exs",
    "erlang": "_SUITE.erl",
    "haskell": "Spec.hs",
    "scala": "Spec.scala",
    "bash": ".bats",
}
DEFAULT_TEST_SUFFIX = ".txt"

# Language -> run command. ``{f}`` is the test file name and
# ``{s}`` the same name without its last extension.
RUN_COMMAND = {
    "python": "python {f}",
    "javascript": "node {f}",
    "typescript": "npx -y tsx {f}",
    "go": "go test {f}",
    "java": "java {f}",
    "rust": "rustc {f} && ./{s}",
    "c": "gcc {f} -o test_bin && ./test_bin",
    "cpp": "g++ {f} -o test_bin && ./test_bin",
    "c-sharp": "csc {f} && mono {s}.exe",
    "ruby": "ruby {f}",
    "kotlin": "kotlinc {f} -include-runtime -d test.jar && java -jar test.jar",
    "swift": "swift {f}",
    "php": "php {f}",
    "dart": "dart test {f}",
    "perl": "perl {f}",
    "lua": "lua {f}",
    "r": "Rscript {f}",
    "elixir": "elixir {f}",
    "erlang": "erlc {f} && erl -noshell -s {s} test -s init stop",
    "haskell": "runhaskell {f}",
    "scala": "scala {f}",
    "bash": "bats {f}",
}
DEFAULT_RUN_COMMAND = "cat {f}"

# Tag of a definition -> node type. Other tags give no node.
TAG_NODE_TYPE = {
    "function": "function",
    "macro": "function",
    "method": "method",
    "class": "class",
    "struct": "class",
    "interface": "class",
    "trait": "class",
}

# Enumerations.
NODE_TYPES = ["function", "method", "class"]
NETWORK_MODES = ["none", "bridge"]
MODES = ["baseline", "adversarial"]
STATUSES = ["pending", "completed", "failed"]
VERDICTS = ["SYSTEM_SECURE", "VULNERABILITY_FOUND", "SYNTAX_ERROR"]

# Limits and defaults.
SEARCH_LIMIT = 10
CHILD_LIMIT = 20
PARENT_LIMIT = 10
MAX_TOKENS = 20000
MAX_RETRIES = 3
PROFILE_NETWORK = "none"
PROFILE_MEMORY = "512m"
PROFILE_CPU = 1.0
PROFILE_TIMEOUT = 30
CPU_PERIOD = 100000
TIMEOUT_GRACE_SECONDS = 1
TIMEOUT_EXIT_CODE = 137
HOST_ERROR_EXIT_CODE = -1
MISSING_STATUS_EXIT_CODE = 1
FINGERPRINT_CHARS = 12
SECRET_MASK = "**********"
BM25_K1 = 1.2
BM25_B = 0.75
BM25_MIN_IDF = 1e-6
URL_NAMESPACE_HEX = "6ba7b8119dad11d180b400c04fd430c8"

# Environment-state fields in output order.
SECRET_MAPS = ["auth_headers", "cookies", "mock_credentials"]
CLEAR_MAPS = ["seeded_entities", "dynamic_endpoints"]
FILE_LIST = "ephemeral_files"
ENV_FIELDS = SECRET_MAPS + CLEAR_MAPS + [FILE_LIST]
