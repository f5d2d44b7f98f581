"""Fixed values the results depend on: word lists, patterns, limits and question texts.

Patterns are written for Java's engine: possessive quantifiers keep its stack flat on long texts,
and look-arounds stand for word boundaries, which it defines over all letters.
"""

from __future__ import annotations

# --- Fixed values: corpus ----------------------------------------------------------------

LANGUAGE_BY_EXTENSION = {
    ".ts": "typescript",
    ".tsx": "typescript",
    ".js": "javascript",
    ".jsx": "javascript",
    ".py": "python",
}
SKIPPED_DIRS = [
    "node_modules", "dist", "build", ".next", "__pycache__", "venv", ".git", "out",
    ".vscode-test", "coverage", ".nyc_output",
]
PRIORITY_DIRS = ["src", "app", "pages", "lib", "api"]
MAX_FILES = 1000
CHUNK_LINES = 2000
PROMPT_LINES = 150
CONTEXT_LINES = 5

# --- Fixed values: risk categories, in order of precedence ----------------------------------

CATEGORY_WORDS = {
    "auth": [
        "auth", "login", "signup", "register", "password", "token", "jwt", "session", "oauth",
        "middleware", "verify", "hash", "bcrypt", "passport",
    ],
    "payments": [
        "payment", "stripe", "razorpay", "checkout", "billing", "subscription", "invoice",
        "charge", "refund", "webhook",
    ],
    "database": [
        "create", "update", "delete", "remove", "destroy", "insert", "mutation", "migrate",
        "prisma", "mongoose", "sequelize", "sql", "query",
    ],
    "error-handling": ["try", "catch", "throw", "error", "reject", "finally"],
    "api-route": [
        "routes/", "api/", "controllers/", "endpoints/", "@app.route", "router.get",
        "router.post", "router.put", "router.delete", "app.get", "app.post", "app.put",
        "app.delete",
    ],
    "security": [
        "cors", "helmet", "csrf", "sanitize", "validate", "encrypt", "decrypt", "secret", "env",
    ],
}
ROUTE_DIRS = ["routes", "api", "controllers", "endpoints"]

# --- Fixed values: patterns for symbols and imports -------------------------------------------

JS_FUNCTION_SYMBOL = (
    r"(?m)(?:^|\s)(?:export\s+)?(?:async\s+)?function\s+(\w+)"
    r"|(?:^|\s)(?:export\s+)?const\s+(\w+)\s*=\s*(?:async\s*)?\("
)
JS_CLASS_SYMBOL = r"(?m)(?:^|\s)(?:export\s+)?class\s+(\w+)"
PY_FUNCTION_SYMBOL = r"(?m)^(?:async\s+)?def\s+(\w+)"
PY_CLASS_SYMBOL = r"(?m)^class\s+(\w+)"
SYMBOL_SPAN = {"function": 10, "js_class": 30, "py_class": 20}
IMPORT = r"(?:import|require)\s*(?:\{[^}]*\}|\*\s+as\s+\w+|\w+)?\s*(?:from\s*)?['\"]([^'\"]+)['\"]"
WIDE_IMPORT = (
    r"(?:(?<!\w)import(?!\w)[^'\";]*?(?:(?<!\w)from\s*)?|(?<!\w)require\s*\(?\s*|(?<!\w)import\s*\(\s*)['\"]([^'\"]+)['\"]"
)

# --- Fixed values: patterns for functions and their facts --------------------------------------

JS_DECLARATION = r"(?:export\s+)?(?:async\s+)?function\s+(\w+)\s*(?:<[^>]*>)?\s*\(([^)]*)\)"
JS_ARROW = (
    r"(?:export\s+)?const\s+(\w+)\s*=\s*(?:async\s+)?\(([^)]*)\)\s*(?::\s*[^=>{]+)?\s*=>"
)
# The first group only says where a match can start at all: at a word or at a modifier.
JS_METHOD = (
    r"(?:(?<!\w)|(?=(?:public|private|protected|static|async|override|readonly)\s))"
    r"(?:(?:(?:public|private|protected|static|async|override|readonly)\s+)*)"
    r"(\w++)\s*+\(([^)]*+)\)\s*(?::\s*[\w<>, |&\[\]?]+)?\s*\{"
)
METHOD_STOP_WORDS = [
    "if", "else", "for", "while", "switch", "catch", "try", "do", "return", "class", "new",
    "typeof", "instanceof", "void", "delete", "in", "of", "case", "default", "break",
    "continue", "throw", "import", "export", "from", "const", "let", "var", "function",
    "async", "await", "yield", "super", "this", "constructor",
]
PY_FUNCTION = r"(?m)^(?:async\s+)?def\s+(\w+)\s*\(([^)]*)\)"

TRY_LINE = r"(?<!\w)try\s*\{"
CATCH = r"(?<!\w)catch\s*\(\s*(\w*)\s*\)"
ONLY_LOGS = r"\A\s*(?:console\.(?:log|error|warn|info|debug)\([^)]*\);?\s*)++\z"
LOG_CALL = r"console\.(?:log|error|warn|info|debug)"
ONLY_COMMENTS = r"\A(?:\s*+(?://.*+)?(?:\n|\z))*+\z"
RETURN_VALUE = r"(?<!\w)return\s+(.*?)(?:;|\n|\z)"
RETURN_BARE = r"(?<!\w)return\s*;"
PROMISE_RETURN = r"(?<!\w)new\s+Promise(?!\w)|Promise\.|(?<!\w)await(?!\w)"
THROW = r"(?<!\w)throw\s+((?:new\s+)?(?:\w+Error|Error)[^;]*?)(?:;|\n|\z)"
AWAIT = r"(?<!\w)await\s+([\w.]+\([^)]*\))"
DOTTED_CALL = r"(?<!\w)((?:this\.)?\w++(?:\.\w++)++)\s*+\("
EXTERNAL_NAMES = [
    "db", "database", "pool", "knex", "prisma", "mongoose", "stripe", "paypal", "braintree",
    "axios", "fetch", "http", "https", "request", "redis", "cache", "memcached", "aws", "s3",
    "sqs", "sns", "ses", "sendgrid", "mailgun", "nodemailer", "twilio", "plaid", "client", "api",
]
FUNCTION_BRANCHES = [
    r"(?<!\w)if\s*\(", r"(?<!\w)else\s+if\s*\(", r"(?<!\w)switch\s*\(", r"(?<!\w)catch\s*\(", r"\?\s", r"\|\|", "&&",
]
FILE_BRANCH = r"(?<!\w)if(?!\w)|(?<!\w)else(?!\w)|(?<!\w)switch(?!\w)|(?<!\w)case(?!\w)|\?\s"

# --- Fixed values: patterns and word lists of the detectors --------------------------------------

FRAMEWORK_PARAMS = ["event", "context", "req", "res", "next"]
SECRETS = [
    (
        r"(?i)(?:api[_-]?key|apikey|secret|password|passwd|pwd|token|auth)"
        r"\s*[:=]\s*['\"][A-Za-z0-9_\-\.]{8,}['\"]",
        "api_key",
    ),
    (r"sk-[A-Za-z0-9]{20,}", "api_key"),
    (r"sk_live_[A-Za-z0-9]{20,}", "api_key"),
    (r"ghp_[A-Za-z0-9]{36}", "token"),
    (r"AKIA[A-Z0-9]{16}", "api_key"),
]
SECRET_KINDS = [
    (r"password|passwd|pwd", "password"),
    (r"token|auth", "token"),
    (r"connection|conn_str|database_url|db_url", "connection_string"),
    (r"api[_-]?key|apikey|secret", "api_key"),
]
SECRET_VARIABLE = r"(?:const|let|var)\s+(\w+)"
SQL_CALL = (
    r"(?:db|pool|connection|knex|client)\.(?:query|execute|run)\s*\(\s*"
    r"(?:`[^`]*\$\{[^}]+\}|['\"][^'\"]*['\"\s]*\+)"
)
REQUEST_DATA = r"(?<!\w)req\.(?:body|params|query)(?!\w)"
VALIDATION_WORDS = [
    "zod", "joi", "yup", "express-validator", "validate", "schema.parse", "z.parse",
]
RESPONSE_SEND = r"(?<!\w)res\s*\.\s*(?:json|send|status)(?!\w)"
ERROR_DETAIL = r"(?<!\w)err(?:or)?\s*\.\s*(?:message|stack)(?!\w)|String\s*\(\s*err(?:or)?\s*\)"
ASSIGNED_CALL = r"(?:const|let|var)\s+(\w+)\s*=\s*(?!await\s)([\w.]+)\s*\("
KNOWN_ASYNC = [
    "db.query", "db.findone", "db.find", "mongoose", "fetch", "axios", "stripe", "redis",
    ".save", ".create", ".update", ".delete",
]
SIDE_EFFECTS = [
    (r"console\.(log|error|warn)", "logs to console"),
    (r"res\.(json|send|status)", "sends HTTP response"),
    (r"\.save\(\)|\.create\(|db\.query|db\.execute", "writes to database"),
    (r"sendEmail|sendMail|nodemailer", "sends email"),
    (r"redis\.set|cache\.set", "writes to cache"),
]
MAX_PATHS = 4

SEVERITY_RANK = {"critical": 0, "high": 1, "medium": 2, "low": 3}
SEVERITY_DIFFICULTY = {"critical": 4, "high": 3, "medium": 2, "low": 1}

# --- Fixed values: score bands, limits ----------------------------------------------------------

REPORT_BANDS = [
    (81, "Deep — you own this codebase"),
    (61, "Solid — some blind spots remain"),
    (31, "Partial — dangerous gaps exist"),
    (0, "Critical — flying blind"),
]
FILE_COLORS = [(80, "green"), (50, "yellow"), (0, "red")]
QUIZ_BANDS = [(80, "deep"), (60, "solid"), (30, "partial"), (0, "critical")]
DANGER_RISK = 7
DANGER_SCORE = 40
CRITICAL_WEIGHT = 3
TREND_STEP = 10
LEARNING_ITEMS = 10
LEARNING_FALLBACK = 5
LOWEST_FILES = 10
START_LEVEL, MIN_LEVEL, MAX_LEVEL = 3, 1, 5
RIGHT_STREAK, WRONG_STREAK = 3, 2
