"""Text measures, classifiers and keyword extraction as Column expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: What query types are told by, in the order they are tried.
QUERY_SIGNS = {
    "temporal": (
        "when", "yesterday", "today", "recent", "last session", "last week", "last time", "this morning", "earlier", "latest", "happened", "history", "timeline", "ago",
        "ne zaman", "dün", "bugün", "geçen", "son oturum", "son zamanlarda", "yakın zamanda", "önce", "geçmişte", "en son", "tarihçe",
    ),
    "causal": (
        "why", "cause", "because", "led to", "resulted in", "root cause", "reason for", "what broke", "what failed", "debug",
        "neden", "niye", "sebep", "yüzünden", "sonuç olarak", "sorun", "hata neden", "kırdı", "bozuldu",
    ),
    "decision": (
        "decide", "decision", "chose", "picked", "agreed on", "settled on", "went with", "trade-off", " vs ", "alternative",
        "karar", "seçtik", "tercih", "neden seçtik", "karşılaştır", "hangisi",
    ),
    "procedural": (
        "how to", "steps", "procedure", "process for", "guide to", "instructions", "walkthrough", "setup", "configure", "install", "deploy", "migrate", "upgrade",
        "nasıl", "adım", "prosedür", "süreç", "kurulum", "yapılandır", "yükle",
    ),
}

#: Weights of the signals for each query type.
SIGNAL_WEIGHTS = {
    "semantic": {"fts": 1.0, "dense": 1.5, "raptor": 1.0, "graph": 0.5, "cue": 0.0},
    "temporal": {"fts": 0.5, "dense": 1.0, "raptor": 0.3, "graph": 0.5, "cue": 1.5},
    "causal": {"fts": 0.5, "dense": 1.0, "raptor": 0.5, "graph": 2.0, "cue": 1.5},
    "decision": {"fts": 1.0, "dense": 1.0, "raptor": 0.5, "graph": 1.0, "cue": 0.0},
    "procedural": {"fts": 1.5, "dense": 1.0, "raptor": 0.5, "graph": 0.3, "cue": 0.0},
}

#: Words that speak for a domain.
DOMAIN_WORDS = {
    "coding": (
        "fn ", "impl ", "async ", "struct ", "enum ", "pub ", "mod ", "error", "bug", "debug", "compile", "cargo", "npm", "git ", "function", "class ", "import ", "export ",
        "const ", "let ", "return ", "if ", "else ", "for ", "while ", "loop ", "api", "endpoint", "database", "query", "migration", "test", "assert", "deploy", "docker",
        "kubernetes", "refactor", "commit", "branch", "merge", "pull request", "stack trace", "exception", "null", "undefined", "```", "rust", "python", "javascript", "typescript",
    ),
    "personal": (
        "feel", "feeling", "today", "yesterday", "tomorrow", "plan", "goal", "want to", "need to", "should", "meeting", "call", "appointment", "schedule", "friend", "family",
        "relationship", "love", "happy", "sad", "birthday", "anniversary", "holiday", "vacation", "trip", "morning", "evening", "night", "weekend", "remember", "forget",
        "think about", "worry", "habit", "routine", "journal", "diary", "note to self", "grocery", "shopping", "cook", "recipe",
    ),
    "research": (
        "research", "study", "paper", "article", "journal", "hypothesis", "experiment", "data", "analysis", "result", "conclusion", "abstract", "methodology", "literature",
        "reference", "citation", "source", "evidence", "theory", "model", "framework", "concept", "university", "academic", "professor", "lecture", "book", "chapter", "page",
        "notes", "summary", "learn", "understand", "explore", "investigate",
    ),
    "health": (
        "health", "doctor", "hospital", "medicine", "prescription", "symptom", "diagnosis", "treatment", "therapy", "exercise", "workout", "gym", "run", "walk", "yoga", "diet",
        "nutrition", "calorie", "protein", "vitamin", "sleep", "rest", "stress", "anxiety", "meditation", "weight", "blood pressure", "heart rate", "bmi", "allergy", "pain",
        "headache", "fever",
    ),
    "finance": (
        "finance", "money", "budget", "expense", "income", "invest", "stock", "bond", "portfolio", "dividend", "bank", "account", "credit", "debit", "loan", "mortgage", "tax",
        "salary", "payment", "bill", "receipt", "saving", "retirement", "insurance", "asset", "crypto", "bitcoin", "ethereum", "trading", "price", "cost", "profit", "loss", "revenue",
    ),
}

#: Words that are no cues, English and Turkish.
STOP_WORDS = (
    "the", "a", "an", "is", "was", "were", "are", "been", "be", "have", "has", "had", "do", "does", "did", "will", "would", "could", "should", "may", "might", "shall", "can", "what",
    "when", "where", "who", "why", "how", "this", "that", "these", "those", "it", "its", "in", "on", "at", "to", "for", "of", "with", "by", "from", "and", "or", "but", "not", "no", "if",
    "then", "so", "about", "up", "out", "just", "also", "very", "all",
    "bir", "bu", "şu", "ve", "ile", "için", "da", "de", "mi", "mu", "mı", "mü", "ne", "nasıl", "neden", "niye",
)

#: Parts of paths, and shell words, that say nothing.
PATH_SKIP = ("src", "lib", "crate", "crates", "mod", "index", "main", "test", "tests", "spec", "specs")
SHELL_SKIP = (
    "ls", "cd", "cat", "echo", "grep", "find", "rm", "mv", "cp", "mkdir", "git", "cargo", "npm", "yarn", "docker", "sudo", "bash", "sh", "zsh", "&&", "||", "|", ">", "<", ">>", "2>&1", "--", "-",
)

#: Files at the root of a project that tell a technology, in the order technologies are listed.
STACK_FILES = {
    "package.json": "node.js", "next.config.js": "next.js", "next.config.ts": "next.js", "next.config.mjs": "next.js", "prisma/schema.prisma": "prisma", "Cargo.toml": "rust",
    "docker-compose.yml": "docker", "docker-compose.yaml": "docker", "Dockerfile": "docker", "flake.nix": "nixos", "requirements.txt": "python", "pyproject.toml": "python", "go.mod": "go", "tsconfig.json": "typescript",
}

#: What tells an error in the output of a command, and words that don't help to search for it.
ERROR_SIGNS = ("error", "panic", "failed", "exception", "fatal", "cannot find", "not found", "no such file", "denied")
ERROR_SKIP = (
    "the", "and", "for", "not", "was", "error", "with", "from", "that", "this", "can", "cannot", "could", "did", "does", "find", "found", "module", "file", "such", "failed", "fatal", "missing",
)


def any_of(text: Column, signs: tuple[str, ...]) -> Column:
    """Whether text holds any of the strings, none of which is a pattern."""
    import re

    return text.rlike("|".join(re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", s) for s in signs))


def estimate_tokens(text: Column) -> Column:
    """A token for every four bytes, rounded up."""
    return F.ceil(F.octet_length(text) / 4.0).cast("bigint")


def truncate_bytes(text: Column, limit: int) -> Column:
    """The longest prefix of at most `limit` bytes that ends with a whole character: three bytes back at most hold a start byte."""
    raw = F.encode(text, "UTF-8")
    cut_ok = F.lit(None).cast("string")
    for back in range(3, -1, -1):
        part = F.substring(raw, 1, limit - back)
        cut_ok = F.when(F.is_valid_utf8(part.cast("string")), part.cast("string")).otherwise(cut_ok)
    return F.when(F.octet_length(text) <= limit, text).otherwise(cut_ok)


def truncate_word(text: Column, limit: int) -> Column:
    """text, or its first `limit` bytes back to the last space, with an ellipsis."""
    head = truncate_bytes(text, limit)
    return F.when(F.octet_length(text) <= limit, text).otherwise(F.concat(F.regexp_replace(head, "(?s) [^ ]*$", ""), F.lit("…")))


def cleanup_whitespace(text: Column) -> Column:
    """No carriage returns, single blanks, no blanks at the start of a later line, two line ends in a row at most."""
    out = F.regexp_replace(text, "\r", "")
    out = F.regexp_replace(out, "[ \t]+", " ")
    out = F.regexp_replace(out, "\n ", "\n")
    return F.regexp_replace(out, "\n{3,}", "\n\n")


def split_sections(text: Column) -> Column:
    return F.filter(F.split(text, "\n\n"), lambda s: F.trim(s) != "")


def classify_query(query: Column) -> Column:
    low, out = F.lower(query), F.lit("semantic")
    for kind in reversed(QUERY_SIGNS):
        out = F.when(any_of(low, QUERY_SIGNS[kind]), kind).otherwise(out)
    return out


def signal_weight(query_type: Column, signal: str) -> Column:
    out = F.lit(SIGNAL_WEIGHTS["semantic"][signal])
    for kind, weights in SIGNAL_WEIGHTS.items():
        out = F.when(query_type == kind, weights[signal]).otherwise(out)
    return out


def domain_of(text: str | None, automaton) -> str:
    found = {w for _, w in automaton.iter((text or "").lower())}
    scores = [(sum(w in found for w in words), i, d) for i, (d, words) in enumerate(DOMAIN_WORDS.items())]
    best, _, domain = max(scores)
    return domain if best >= 3 else "general"


def detect_domain(text: Column) -> Column:
    """The domain with most words in the text, the last of equals; general below three and for null. One automaton finds all
    two hundred words in one pass, which is several times as fast as as many searches inside the JVM."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for words in DOMAIN_WORDS.values():
            for w in words:
                automaton.add_word(w, w)
        automaton.make_automaton()
        return pd.Series([domain_of(t, automaton) for t in texts], dtype=object)

    return run(text)


def classify_severity(subject: Column) -> Column:
    low = F.lower(subject)
    return F.when(low.startswith("fix") | low.startswith("feat") | low.startswith("refactor") | low.contains("bug") | low.contains("critical"), "medium").otherwise("low")


def extract_cues(query: Column) -> Column:
    """Words of three bytes at least that aren't stop words; hyphens and underscores belong to words."""
    words = F.split(F.lower(query), "[^\\p{L}\\p{N}_-]+")
    return F.filter(words, lambda w: (F.octet_length(w) >= 3) & ~w.isin(*STOP_WORDS))


def keywords_path(path: Column) -> Column:
    parts = F.filter(F.split(path, "[/\\\\.\\-_]"), lambda p: (F.octet_length(p) > 2) & ~p.isin(*PATH_SKIP))
    return F.when(F.size(parts) > 0, F.array_join(F.slice(parts, 1, 4), " "))


def keywords_shell(command: Column) -> Column:
    words = F.filter(F.split(command, "\\s+"), lambda w: (F.octet_length(w) > 2) & ~w.isin(*SHELL_SKIP) & ~w.startswith("-"))
    return F.when(F.size(words) > 0, F.array_join(F.slice(words, 1, 3), " "))


def error_keywords(text: Column) -> Column:
    """Up to four words of a text that reports an error, joined for a search that any may match; null for other texts."""
    words = F.filter(F.split(text, "[^\\p{L}\\p{N}_-]+"), lambda w: (F.octet_length(w) >= 3) & ~F.lower(w).isin(*ERROR_SKIP))
    return F.when(any_of(F.lower(text), ERROR_SIGNS) & (F.size(words) > 0), F.array_join(F.slice(words, 1, 4), " OR "))


def letter_words(text: Column) -> Column:
    """The runs of letters and digits in text, in lower case."""
    return F.filter(F.split(F.lower(text), "[^\\p{L}\\p{N}]+"), lambda w: w != "")


def trigrams(text: Column) -> Column:
    """The set of three-letter runs of the words of text, each padded with two blanks before and one after."""
    padded = F.transform(letter_words(text), lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    runs = F.transform(padded, lambda p: F.transform(F.sequence(F.lit(1), F.length(p) - 2), lambda i: F.substring(p, i, F.lit(3))))
    return F.array_distinct(F.flatten(runs))


def trigram_similarity(a: Column, b: Column) -> Column:
    """Shared trigrams by all trigrams; 0 where there are none."""
    x, y = trigrams(a), trigrams(b)
    union = F.size(F.array_union(x, y))
    return F.when(union > 0, F.size(F.array_intersect(x, y)) / union).otherwise(0.0)


def normalized_message(message: Column) -> Column:
    """A log message without what varies: runs of digits become <N>, other punctuation than . : - _ goes."""
    bare = F.regexp_replace(message, "[^\\p{L}\\p{N}\\s.:_-]", "")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, "[0-9]+", "<N>"), "\\s+", " "))


def fingerprint(target: Column, message: Column) -> Column:
    return F.substring(F.sha2(F.concat(target, F.lit("::"), normalized_message(message)), 256), 1, 32)


def url_host(url: Column) -> Column:
    return F.regexp_extract(url, "^(?:https?://)*([^/:]*)", 1)


def is_private_url(url: Column) -> Column:
    """Whether the host is this machine, a private, loopback or link-local address, or an internal name."""
    host = url_host(url)
    octet = "(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
    ranges = f"^(127\\.{octet}\\.{octet}|10\\.{octet}\\.{octet}|192\\.168\\.{octet}|172\\.(1[6-9]|2[0-9]|3[01])\\.{octet}|169\\.254\\.{octet})\\.{octet}$"
    return host.isin("localhost", "0.0.0.0") | host.rlike(ranges) | host.rlike("\\.(local|internal|lan)$") | url.rlike("^(https?://)?(\\[?::1\\]?)(/|:|$)")


def tech_stack(file: Column) -> Column:
    """The technology that a file, named from the root of its project, tells of; null for other files."""
    out = F.lit(None).cast("string")
    for marker, tech in STACK_FILES.items():
        out = F.when(file == marker, tech).otherwise(out)
    return out


def tech_stacks(files: Column) -> Column:
    """The technologies that a project's files (an array of paths from its root) tell of, each once, in their fixed order."""
    told = F.array(*(F.when(F.array_contains(files, marker), F.lit(tech)) for marker, tech in STACK_FILES.items()))
    return F.array_distinct(F.filter(told, lambda t: t.isNotNull()))


def passes_gate(title: Column, content: Column) -> Column:
    """Whether a record says enough to keep: 50 bytes of content, 5 of title, and not the same."""
    t, c = F.trim(title), F.trim(content)
    return F.coalesce((F.octet_length(c) >= 50) & (F.octet_length(t) >= 5) & (t != c), F.lit(False))


def passes_procedure_gate(title: Column, content: Column, steps: Column) -> Column:
    return passes_gate(title, content) & F.coalesce(F.size(steps) >= 2, F.lit(False))


def snippet(content: Column, chars: int = 150) -> Column:
    return F.left(content, F.lit(chars))


def headline(text: Column, terms: list[str], words: int = 20) -> Column:
    """A fragment of up to `words` words around the first term found, terms marked with << and >>."""
    import re

    alternation = "|".join(re.escape(t) for t in terms)
    around = f"(?is)(?:\\S+\\s+){{0,{words // 2}}}\\S*\\b(?:{alternation})\\b\\S*(?:\\s+\\S+){{0,{words // 2}}}"
    return F.regexp_replace(F.regexp_extract(text, around, 0), f"(?i)\\b({alternation})\\b", "<<$1>>")


def strip_fences(text: Column) -> Column:
    """JSON in a model's answer, without the code fence around it."""
    inner = F.regexp_extract(text, "(?s)```(?:json)?\\s*(.*?)```", 1)
    return F.regexp_replace(F.when(inner != "", inner).otherwise(text), "^\\s+|\\s+$", "")


def json_with(json: Column, key: str, value: Column) -> Column:
    """A JSON object with a key set to a string, other keys as they are; null and what isn't an object count as empty."""
    held = F.coalesce(F.from_json(json, "map<string,string>"), F.expr("cast(map() as map<string,string>)"))
    others = F.map_filter(held, lambda k, _: k != key)
    return F.to_json(F.map_concat(others, F.create_map(F.lit(key), value)))
