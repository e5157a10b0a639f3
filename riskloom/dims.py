"""Fixed dimension tables (A22): knowledge base, hints, templates, export rules.

Keys, their order, rule ids, levels and reference links are fixed values that
results depend on.  Summaries, explanations and fixes are our own wording.
Every table here has a constant, small row count, so broadcasting it is safe
at any data size.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHEETS = "https://cheatsheetseries.owasp.org/"
SHEET = SHEETS + "cheatsheets/"
TOP_TEN = "https://owasp.org/www-project-top-ten/"
COMMUNITY = "https://owasp.org/www-community/"
CERT_C = "https://wiki.sei.cmu.edu/confluence/display/c/SEI+CERT+C+Coding+Standard"

# D13 - fixed values: key order and reference links.  (key, summary, fix, references)
KB = [
    ("hardcoded secret", "A credential written into source is readable by everyone who can read the repository.", "Load it from a secret manager or the environment and rotate the exposed value.", [SHEET + "Secrets_Management_Cheat_Sheet.html", TOP_TEN]),
    ("possible sql injection", "A query assembled from strings lets input change the statement itself.", "Bind values as parameters, or go through an ORM.", [SHEET + "SQL_Injection_Prevention_Cheat_Sheet.html", COMMUNITY + "attacks/SQL_Injection"]),
    ("insecure function usage", "Functions that run text as code hand control to whoever supplies the text.", "Parse the input with a restricted parser instead of running it.", [COMMUNITY]),
    ("deprecated hash", "MD5 and SHA-1 collide in practice and no longer protect anything.", "Move to SHA-256 or better; use a password hash for passwords.", ["https://www.ipa.go.jp/security/english/", SHEET + "Cryptographic_Storage_Cheat_Sheet.html"]),
    ("suspicious subprocess call", "Starting a program with untrusted arguments can run commands nobody intended.", "Pass an argument list, keep the shell off, check the arguments.", [SHEETS]),
    ("insecure regex", "A pattern that matches nearly everything checks nothing and may backtrack badly.", "Anchor the pattern and bound its repeats.", [COMMUNITY]),
    ("broken access control", "Users reach data or actions that are not theirs.", "Check the permission on the server for each request.", [SHEET + "Access_Control_Cheat_Sheet.html", TOP_TEN]),
    ("cross site scripting", "Unescaped input becomes script in another user's browser.", "Encode on output for the right context and add a content policy.", [SHEET + "Cross_Site_Scripting_Prevention_Cheat_Sheet.html"]),
    ("security misconfiguration", "Default or loose settings leave doors open.", "Harden the defaults and review them on each release.", [TOP_TEN]),
    ("insufficient logging", "Attacks go unseen when nothing records them.", "Record security events centrally and alert on them.", [SHEETS]),
    ("open redirect", "A redirect target taken from input sends users to hostile sites.", "Redirect only to targets from an allow list.", [COMMUNITY + "attacks/Redirection_attack"]),
    ("insecure deserialization", "Rebuilding objects from untrusted bytes can run code.", "Exchange plain data formats and validate them against a schema.", [SHEET + "Insecure_Deserialization_Cheat_Sheet.html"]),
    ("unencrypted sensitive data", "Private data in clear text leaks with any copy of it.", "Encrypt it at rest and in transit.", [TOP_TEN]),
    ("insufficient input validation", "Unchecked input reaches code that trusts it.", "Validate type, length and range at the boundary.", [SHEETS]),
    ("server side request forgery", "The server can be made to call addresses chosen by an attacker.", "Allow only listed hosts and block internal ranges.", [SHEETS]),
    ("csrf", "Another site can send requests in the name of a signed-in user.", "Require an unguessable token on each state change.", [SHEET + "Cross-Site_Request_Forgery_Prevention_Cheat_Sheet.html"]),
    ("xxe", "An XML parser that resolves external entities reads files and calls hosts.", "Turn external entities off in the parser.", [SHEET + "XML_External_Entity_Prevention_Cheat_Sheet.html"]),
    ("path traversal", "A file name from input can climb out of its folder.", "Resolve the path and check that it stays below the base folder.", [SHEETS]),
    ("insecure cookie", "Cookies without protective flags can be read or replayed.", "Set Secure, HttpOnly and SameSite.", [SHEETS]),
    ("clickjacking", "A hidden frame makes users click what they cannot see.", "Forbid framing by header.", [SHEETS]),
    ("broken cryptography", "Weak algorithms or home-made schemes fail under attack.", "Use current algorithms from a maintained library.", [SHEET + "Cryptographic_Storage_Cheat_Sheet.html"]),
    ("token leakage", "Tokens end up in logs, links or error pages.", "Keep tokens out of URLs and mask them in logs.", [SHEETS]),
    ("rate limiting missing", "Nothing slows an automated client down.", "Limit requests per client and time span.", [SHEETS]),
    ("large file upload", "Unbounded uploads exhaust disk or memory.", "Set a size limit and stream to storage.", [SHEETS]),
    ("insecure cors", "A wide cross-origin policy opens the API to any site.", "List the origins that may call.", [SHEETS]),
    ("improper error handling", "Raw errors show internals to outsiders.", "Return a plain message and log the details.", [SHEETS]),
    ("weak password policy", "Short or common passwords are guessed quickly.", "Ask for length and reject known leaked passwords.", [SHEETS]),
    ("exposed debug endpoint", "Debug pages show state and may run code.", "Remove them from production builds.", [SHEETS]),
    ("directory listing", "File lists help an attacker find what to take.", "Turn automatic indexes off.", [SHEETS]),
    ("missing security headers", "Browsers get no instructions to protect the user.", "Send the standard set of security headers.", [SHEETS]),
    ("weak tls ciphers", "Old ciphers let traffic be read.", "Accept only current protocol versions and suites.", [SHEETS]),
    ("improper input sanitization", "Input keeps characters that mean something further on.", "Encode for the place where the value is used.", [SHEETS]),
    ("insecure direct object reference", "Guessing an identifier opens somebody else's record.", "Check ownership on each access.", [SHEETS]),
    ("server side template injection", "Input rendered as a template runs on the server.", "Never build templates from input.", [SHEETS]),
    ("supply chain dependency tampering", "A changed package brings foreign code into the build.", "Pin versions and verify checksums.", [SHEETS]),
    ("improper authentication", "The identity check can be skipped or fooled.", "Use a proven identity service.", [SHEETS]),
    ("missing multi factor authentication", "A stolen password is enough to get in.", "Ask for a second factor.", [SHEETS]),
    ("improper session management", "Session ids can be guessed, fixed or kept too long.", "Renew ids on sign-in and end idle sessions.", [SHEETS]),
    ("weak randomness", "Predictable numbers make keys and tokens guessable.", "Draw them from a cryptographic generator.", [SHEETS]),
    ("missing rate limiting on auth", "Passwords can be tried without end.", "Slow down and lock repeated failures.", [SHEETS]),
    ("insecure dependency versions", "Known holes stay open in outdated packages.", "Update and scan dependencies regularly.", [TOP_TEN]),
    ("improper certificate validation", "An unchecked certificate lets anyone pose as the server.", "Verify the chain and the host name.", [SHEETS]),
    ("insecure mobile storage", "Data on the device can be read by other apps.", "Use the platform key store.", [SHEETS]),
    ("exposed backup or git artifacts", "Backups and repository folders give the source away.", "Keep them out of the web root.", [SHEETS]),
    ("zip slip", "Archive members can be written outside the target folder.", "Check each member path before extracting.", [SHEETS]),
    ("format string vulnerability", "Input used as a format reads or writes memory.", "Keep formats constant.", [SHEETS]),
    ("integer overflow", "Arithmetic wraps and sizes come out wrong.", "Check bounds before computing.", [SHEETS]),
    ("improper cloud permissions", "Roles grant more than the job needs.", "Grant the least that works.", [SHEETS]),
    ("exposed api keys in build", "Keys end up in build output or images.", "Inject keys at run time only.", [SHEETS]),
    ("certificate pinning missing", "A forged certificate goes unnoticed by the client.", "Pin the key in sensitive clients.", [SHEETS]),
    ("race condition in critical path", "Two actions at once break a check.", "Make check and use one atomic step.", [SHEETS]),
    ("privilege escalation", "A low account gains the rights of a high one.", "Separate duties and check rights at each step.", [SHEETS]),
    ("backup credentials stored in repo", "Backup passwords travel with the code.", "Move them to a vault and rotate them.", [SHEETS]),
    ("missing content security policy", "The browser runs script from anywhere.", "Send a strict content policy.", [SHEETS]),
]

# D14 - fixed values: key order (first match wins).
HINTS = [
    ("hardcoded secret", "Keep secrets out of code: read them from a vault or the environment, and rotate what was exposed."),
    ("sql injection", "Send values as bound parameters; never glue input into SQL text."),
    ("insecure function", "Do not run text as code; parse it with something that cannot execute."),
    ("insecure deserialization", "Never unpack untrusted bytes into objects; exchange plain data instead."),
    ("command injection", "Run programs with an argument list and without a shell, and validate each argument."),
    ("deprecated hash", "Replace MD5 and SHA-1 by SHA-256 or a password hash."),
    ("insecure regex", "Anchor and bound the pattern so that it cannot match everything."),
    ("insecure tls", "Keep certificate verification on."),
    ("xss", "Escape what you put into the page, or write it as text."),
    ("path traversal", "Resolve the path and check it against the allowed folder."),
]
HINT_DEFAULT = "Look at the finding and follow secure coding practice."

# D15 - fixed values: key order (first match wins) and reference links.
TEMPLATES = [
    ("hardcoded secret", "A credential is stored in this file, so every reader of the code has it.", "Take it out of version control, use a secret store, rotate it now.", [TOP_TEN, SHEET + "Secrets_Management_Cheat_Sheet.html"]),
    ("hardcoded api key", "An API key is part of the source and can be used by anyone who sees it.", "Read the key from configuration at run time and revoke this one.", [SHEET + "Secrets_Management_Cheat_Sheet.html"]),
    ("aws access key", "A cloud access key id is in the code; with its secret it opens the account.", "Deactivate the key and give the workload a role.", ["https://docs.aws.amazon.com/IAM/latest/UserGuide/best-practices.html"]),
    ("hardcoded password", "A password is assigned as a literal.", "Ask for it at run time or read it from a vault.", [SHEET + "Secrets_Management_Cheat_Sheet.html"]),
    ("jwt token", "A signed token is embedded and can be replayed until it expires.", "Issue tokens at run time and revoke this one.", [SHEET + "JSON_Web_Token_for_Java_Cheat_Sheet.html"]),
    ("private key", "A private key is in the source, so the identity it proves is lost.", "Replace the key pair and keep the new one in a key store.", [SHEET + "Key_Management_Cheat_Sheet.html"]),
    ("possible sql injection", "SQL text is put together from parts, so input can rewrite the query.", "Use bound parameters.", [SHEET + "SQL_Injection_Prevention_Cheat_Sheet.html"]),
    ("sql injection", "Input can become part of the SQL statement.", "Use bound parameters or an ORM.", [SHEET + "SQL_Injection_Prevention_Cheat_Sheet.html"]),
    ("insecure function usage", "A function that runs text as code is called.", "Choose a parser that does not execute its input.", [COMMUNITY]),
    ("eval", "eval runs any expression it is given.", "Parse literals only.", [COMMUNITY]),
    ("exec", "exec runs any statement it is given.", "Dispatch to known functions instead.", [COMMUNITY]),
    ("insecure deserialization", "Objects are rebuilt from bytes that may be hostile.", "Use a data-only format.", [SHEET + "Deserialization_Cheat_Sheet.html"]),
    ("pickle", "Unpickling can call any function.", "Use JSON or another data-only format.", [SHEET + "Deserialization_Cheat_Sheet.html"]),
    ("yaml", "The full YAML loader can build any object.", "Use the safe loader.", ["https://pyyaml.org/wiki/PyYAMLDocumentation"]),
    ("suspicious subprocess call", "An external program is started.", "Pass a list, avoid the shell, check arguments.", [SHEETS]),
    ("subprocess", "A program is started through the shell.", "Drop the shell and pass a list.", [SHEETS]),
    ("os.system", "A command line is run by the shell.", "Use a process API with a list of arguments.", [SHEETS]),
    ("command injection", "Input may reach a command line.", "Separate command and arguments.", [SHEET + "OS_Command_Injection_Defense_Cheat_Sheet.html"]),
    ("child_process", "The process module is loaded and may run commands.", "Prefer the variant that takes an argument list.", [SHEETS]),
    ("deprecated hash", "A broken hash algorithm is used.", "Use SHA-256 or stronger.", [TOP_TEN]),
    ("insecure random", "A predictable generator feeds a security value.", "Use the secrets module.", ["https://docs.python.org/3/library/secrets.html"]),
    ("insecure regex", "The pattern accepts almost any input.", "Anchor and bound it.", [COMMUNITY]),
    ("xss", "Content may be written to the page unescaped.", "Escape it or write it as text.", [SHEET + "Cross_Site_Scripting_Prevention_Cheat_Sheet.html"]),
    ("innerhtml", "Markup is assigned from a value.", "Assign text content.", [SHEET + "Cross_Site_Scripting_Prevention_Cheat_Sheet.html"]),
    ("tls", "Certificate checks are off.", "Turn verification on.", [SHEET + "Transport_Layer_Security_Cheat_Sheet.html"]),
    ("debug", "Debug mode shows internals.", "Switch it off outside development.", [TOP_TEN]),
    ("path traversal", "A file is opened by a name that comes from outside.", "Resolve and check the path.", [SHEET + "File_Upload_Cheat_Sheet.html"]),
    ("dangerous c function", "A C function without bounds checks is called.", "Use the bounded variant.", [CERT_C]),
    ("dangerous function", "A risky C or C++ function is called.", "Use a safer interface.", [CERT_C]),
    ("tempfile", "A temporary name is made before the file exists.", "Create the file in one step.", [COMMUNITY]),
    ("assert", "An assert guards something, and asserts can be compiled out.", "Raise an error explicitly.", ["https://docs.python.org/3/reference/simple_stmts.html#the-assert-statement"]),
    ("format string", "A variable is used as the format.", "Use a constant format.", [COMMUNITY + "attacks/Format_string_attack"]),
]
GENERIC_FIX = "Examine the finding and apply the usual remedies: bound parameters, secret stores, safer APIs."
GENERIC_REFERENCES = [TOP_TEN]

# D16 - fixed values: export rule ids and levels.  (type, id, short, help, level)
EXPORT_RULES = [
    ("Insecure Function Usage", "CG1001", "Call that runs text as code", "Do not run text as code.", "warning"),
    ("Hardcoded Secret", "CG1002", "Credential in source", "Keep credentials out of source.", "error"),
    ("Possible SQL Injection", "CG1003", "SQL built from strings", "Bind parameters.", "error"),
    ("Suspicious Subprocess Call", "CG1004", "External program started", "Validate arguments, avoid the shell.", "warning"),
    ("Dangerous Function", "CG1005", "Risky C or C++ call", "Use bounded functions.", "error"),
    ("Insecure Regex", "CG1006", "Pattern too broad", "Narrow the pattern.", "note"),
    ("Deprecated Hash", "CG1007", "Weak hash", "Use SHA-256 or stronger.", "warning"),
]
EXPORT_DEFAULT = ("CG9999", "warning")

VENDOR_DIRS = ["node_modules", "venv", ".venv", "build", "dist"]
SOURCE_EXTENSIONS = [".py", ".js", ".cpp"]

SEVERITY_WEIGHTS = {"High": 5, "Medium": 3, "Low": 1}
UNKNOWN_WEIGHT = 3


def kb(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [(i, k, s, f, r) for i, (k, s, f, r) in enumerate(KB)],
        "ord int, key string, summary string, fix string, references array<string>",
    )


def hints(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, k, t) for i, (k, t) in enumerate(HINTS)], "ord int, key string, text string")


def templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [(i, k, e, f, r) for i, (k, e, f, r) in enumerate(TEMPLATES)],
        "ord int, key string, explanation string, fix string, references array<string>",
    )


def export_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(EXPORT_RULES, "type string, rule_id string, short string, help string, level string")


def strings(values: list[str]) -> Column:
    """A literal array<string>."""
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def first_match(query: Column, keys: list[str]) -> Column:
    """1-based position of the first key contained in, or containing, `query` (O6); null if none.

    The key list is fixed, so the theta join against the dimension becomes one
    CASE that stops at the first hit: no join, no shuffle.
    """
    def hit(k: str) -> Column:
        return F.contains(query, F.lit(k)) | F.contains(F.lit(k), query)

    head, *rest = [(hit(k), F.lit(i)) for i, k in enumerate(keys, 1)]
    return reduce(lambda acc, cv: acc.when(*cv), rest, F.when(*head))
