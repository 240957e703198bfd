"""Patterns, word lists, labels and limits that define the results.

Every entry is part of the data contract. Patterns use Java syntax; ``(?iU)`` asks for
case-insensitive matching with Unicode classes.
"""

# ---- text shape -----------------------------------------------------------------------------
ANSI = r"(?:\x1B[@-_][0-?]*[ -/]*[@-~])|(?:\x1B\][^\x07]*(?:\x07|\x1B\\))"
LINE_BREAK = "\\r\\n|[\\n\\r\\x0B\\f\\x1C-\\x1E\\x85\\u2028\\u2029]"
CJK = "[\\u3000-\\u9fff\\uac00-\\ud7af\\uf900-\\ufaff]"
STRUCTURAL = r"[{}\[\]():,.;<>/=+*|&!`~^%-]"
ASCII_BREAKS = ["\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e"]
WIDE_BREAKS = ["\x85", "\u2028", "\u2029"]
WHITE_SPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
BINARY_CONTROLS = r"[\x01-\x08\x0e-\x1f]"
BINARY_CONTROL_SHARE = 0.03

# ---- volatile values masked in templates, in this order --------------------------------------
UUID = r"(?U)\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[1-5][0-9a-fA-F]{3}-[89abAB][0-9a-fA-F]{3}-[0-9a-fA-F]{12}\b"
TIMESTAMP = r"(?U)(?:\b\d{4}-\d{2}-\d{2}[T ][0-9:.+\-Z]+\b)|(?:\b\d{2}:\d{2}:\d{2}(?:\.\d+)?\b)"
HEX_ID = r"(?U)\b(?:0x)?[0-9a-fA-F]{8,}\b"
NUMBER = r"(?U)(?<![A-Za-z_])[-+]?\d+(?:\.\d+)?(?![A-Za-z_])"

# ---- decisive lines and secrets ---------------------------------------------------------------
CRITICAL_LINE = (
    r"(?iU)(?:\b(?:error|fatal|critical|panic|exception|traceback|failed|failure|assert(?:ion)?|"
    r"segfault|denied|timeout)\b"
    r"|(?:^|\s)(?:E\s+|F\s+)"
    r"|(?:^|\s)(?:[A-Za-z0-9_./\\-]+:\d+(?::\d+)?)"
    r"|(?:exit(?:ed)?\s+(?:code|status)\s*[:=]?\s*[1-9]\d*))"
)
SECRET = (
    r"(?iU)(?:"
    r"(?:api[_-]?key|access[_-]?key|access[_-]?token|auth[_-]?token|client[_-]?secret|"
    r"private[_-]?key|secret|token|password|passwd|authorization|credential|database[_-]?url)\s*[:=]\s*\S+"
    r"|\bauthorization\s*:\s*bearer\s+\S+"
    r"|\bbearer\s+[A-Za-z0-9._~+/=-]{16,}"
    r"|-----BEGIN [A-Z ]*PRIVATE KEY-----"
    r"|\b(?:sk|rk)-[A-Za-z0-9_-]{16,}"
    r"|\bgh[pousr]_[A-Za-z0-9]{20,}"
    r"|\bgithub_pat_[A-Za-z0-9_]{20,}"
    r"|\bAKIA[0-9A-Z]{16}\b)"
)
# One of these occurs, in any case, in every text that matches SECRET.
SECRET_HINTS = [
    "key", "token", "secret", "passw", "authorization", "credential", "url", "bearer", "sk-", "rk-", "ghp_", "gho_",
    "ghu_", "ghs_", "ghr_", "github_pat_", "akia",
]
SECRET_ARGUMENT_NAME = (
    r"(?:api[-_]?key|access[-_]?key|access[-_]?token|auth[-_]?token|client[-_]?secret|"
    r"private[-_]?key|secret|token|password|passwd|authorization|credential|credentials|database[-_]?url)"
)
SECRET_FLAG = rf"(?iU)^(?:--?)?{SECRET_ARGUMENT_NAME}\z"
SECRET_ASSIGNMENT = rf"(?iU)(?:^|[\s?&;,=])(?:--?)?{SECRET_ARGUMENT_NAME}\s*[:=]"
REDACTED = "<redacted>"

# ---- logs -------------------------------------------------------------------------------------
LOG_LEVEL = r"(?iU)\b(TRACE|DEBUG|INFO|NOTICE|WARN(?:ING)?|ERROR|FATAL|CRITICAL|PANIC)\b"
CRITICAL_LEVELS = ["ERROR", "FATAL", "CRITICAL", "PANIC"]
WARNING_LEVELS = ["WARN", "WARNING"]
LOG_TRACE_WORDS = r"(?iU)\b(?:exception|traceback|segfault|stack trace)\b"
SEVERITY_WORDS = r"(?iU)\b(?:trace|debug|info|warn(?:ing)?|error|fatal|critical|panic)\b"

# ---- progress ---------------------------------------------------------------------------------
PROGRESS_PERCENT = r"(?U)\b\d{1,3}%\b"
PROGRESS_BAR = r"\[[#=*>.\- ]{5,}\]"
PROGRESS_VERB = r"(?iU)(?:downloading|uploading|building|compiling|processing)\b.*\d"

# ---- search matches ---------------------------------------------------------------------------
MATCH_HEAD = r"(?U)^.*?[:\-]\d+[:\-]"
ERROR_MATCH = (
    r"(?iU)(?:\b(?:fatal|critical|panic|failed|failure|denied|timeout)\b"
    r"|\b[A-Za-z_][A-Za-z0-9_]*(?:Error|Exception)\b|\berror\b|\bexception\b)"
)
SYMBOL_DEFINITION = (
    r"(?iU)(?:^|\b)(?:async\s+def|def|class|interface|enum|struct|type|func|fn|impl|const|let|var|function)\b"
)
ALIAS_MIN_REPEATS = 3
ALIAS_MIN_GAIN = 24
ALIAS_FIXED_COST = 4

# ---- listings ---------------------------------------------------------------------------------
KEY_FILES = [
    "readme.md", "agents.md", "pyproject.toml", "package.json", "cargo.toml", "go.mod",
    "makefile", "dockerfile", "compose.yaml", "docker-compose.yml", ".gitignore", "tsconfig.json",
]
TREE_NODE = r"(?U)^((?:(?:│|\|)   |    )*)(?:├── |└── |\|-- |`-- )(.+?)\s*$"
TREE_MARKS = ["├──", "└──", "|-- ", "`-- "]
TREE_TOTALS = r"(?iU)^\d+ director(?:y|ies), \d+ files?\z"
LONG_LISTING = r"(?U)^(?:[-dlcbps][rwxStTs-]{9}[+@.]?|[0-9/\-]{6,}\s+[0-9:]{4,})\s+"
TREE_MIN_LINES = 80
TREE_EXTENSIONS_SHOWN = 20

# ---- test runners -----------------------------------------------------------------------------
TEST_FAILURE_WORD = r"(?iU)\b(?:fail(?:ed|ure|ures)?|error|exception|traceback|panic|assert(?:ion)?)\b"
TEST_FAILURE_START = r"(?iU)^(?:E\s+|F\s+|_{2,}\s*.*\s*_{2,}$|={2,}\s*(?:FAILURES?|ERRORS?)\s*={2,})"
FAILURE_HINTS = ["fail", "error", "exception", "traceback", "panic", "assert"]
TEST_SUMMARY_COUNT = r"(?iU)\b\d+\s+(?:passed|failed|skipped|xfailed|xpassed|warnings?|tests?)\b"
TEST_SUMMARY_HEAD = (
    r"(?iU)^(?:(?:test suites|tests|snapshots|time|ran all test suites)\s*:"
    r"|test result:|failures:|successfully ran|build (?:succeeded|failed)|finished test|ok\s|FAIL\s)"
)
TEST_PROGRESS_ONLY = r"(?U)^[.sFxXEP]+\s*(?:\[[^]]+\])?\s*\z"
TEST_PROGRESS_MIN_CHARS = 10
TEST_LOCATION = r"(?U)(?:[A-Za-z0-9_.\-/\\]+:\d+(?::\d+)?|-->\s+[^:]+:\d+:\d+)"
WARNING_HINTS = ["warn", "deprecated"]
TEST_WARNING = r"(?iU)\bwarn(?:ing)?\b|deprecated"

# ---- git --------------------------------------------------------------------------------------
GIT_LONG_STATE = (
    r"(?iU)^\s*(modified|deleted|new file|renamed|copied|typechange|both modified):\s+(.+)$"
)
GIT_PORCELAIN = r"(?U)^([ MADRCU?!]{2}|\?\?)\s+(.+)$"
GIT_STATE_NOTE = (
    r"(?iU)(?:rebase in progress|merge in progress|cherry-pick|revert in progress|bisecting|unmerged paths)"
)
GIT_HELP = r"(?iU)^\s*\(use \"git .+\".*\)\s*$"
GIT_STATE_CODES = {
    "modified": "M", "deleted": "D", "new file": "A", "renamed": "R",
    "copied": "C", "typechange": "T", "both modified": "U",
}
GIT_HEADER = r"^(Author|Date|Merge):"
GIT_HUNK = r"(?m)^@@ .* @@"

# ---- JSON values ------------------------------------------------------------------------------
JSON_CRITICAL_WORDS = r"(?iU)\b(?:error|fatal|critical|panic|exception|failed|failure|denied|timeout)\b"
JSON_STRONG_KEYS = ["error", "errors", "exception", "fatal", "failed", "failure", "exit_code"]
JSON_MAX_DEPTH = 8
JSON_HEAD_ITEMS = 3
JSON_TAIL_ITEMS = 2

# ---- routing ----------------------------------------------------------------------------------
TEST_COMMANDS = [
    "pytest", "py.test", "jest", "vitest", "mocha", "rspec", "cargo", "go", "gradle", "gradlew", "mvn", "dotnet",
]
PACKAGE_COMMANDS = ["npm", "pnpm", "yarn", "bun"]
PACKAGE_TEST_WORDS = ["test", "jest", "vitest", "mocha"]
SEARCH_COMMANDS = ["rg", "grep", "egrep", "fgrep", "ack", "ag"]
TREE_COMMANDS = ["tree", "find", "fd", "ls", "dir"]
LOG_COMMANDS = ["tail", "head", "cat", "journalctl", "dmesg", "kubectl", "docker"]
TEST_MARKERS = [
    "short test summary info", "test suites:", "tests:", "failures", "collected ", "test result:",
    "ran all test suites",
]
KINDS = ["generic", "test", "log", "json", "git_status", "git_diff", "git_log", "search", "tree"]

# ---- decision ---------------------------------------------------------------------------------
MIN_OMISSION_CONFIDENCE = 0.72
DEFAULT_MIN_BYTES = 2048
DEFAULT_MIN_LINES = 40
DEFAULT_MIN_SAVINGS = 0.08
DEFAULT_RETENTION_DAYS = 7
ID_LENGTHS = [16, 24, 32, 40, 64]
ARTIFACT_ID = r"^[0-9a-fA-F]{4,64}\z"

# ---- profile knobs ----------------------------------------------------------------------------
KNOBS = {
    "json_cap": {"safe": 12, "max": 6},
    "search_samples": {"safe": 6, "max": 3},
    "search_unparsed": {"safe": 20, "max": 8},
    "tree_samples": {"safe": 12, "max": 5},
    "tree_top_samples": {"safe": 30, "max": 15},
    "log_radius": {"safe": 3, "max": 2},
    "log_min_family": {"safe": 1, "max": 3},
    "log_templates_shown": {"safe": 40, "max": 20},
    "fail_radius": {"safe": 4, "max": 2},
    "pass_radius": {"safe": 2, "max": 1},
}
LOG_HEAD, LOG_TAIL = 5, 8
FAIL_HEAD, FAIL_TAIL = 6, 20
PASS_HEAD, PASS_TAIL = 5, 12
GENERIC_WINDOW_ABOVE, GENERIC_RADIUS, GENERIC_HEAD, GENERIC_TAIL = 120, 2, 8, 16
COMMIT_BODY_LINES = 2
