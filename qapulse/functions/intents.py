"""Rule-based intent of a question: the first matching pattern over title and prose wins."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_INTENT = "API Usage"

# Intents in order of precedence with their case-insensitive search patterns. Most
# alternatives have no word boundary on purpose, so parts of words match.
INTENT_PATTERNS = {
    "Machine-Authored Discrepancy": (
        r"(chatgpt|gpt[-\s]?[34o]|copilot|github\s*copilot|ai[-\s]generat|"
        r"llm|claude|gemini|bard|codewhisperer|code[-\s]?llama|"
        r"ai[-\s]?suggest|ai[-\s]?writ|ai[-\s]?code|generated\s+code|"
        r"ai\s+assistant|large\s+language\s+model)"
    ),
    "Architectural Consensus": (
        r"(best\s+(practice|approach|way|pattern|strategy|design|architecture)|"
        r"design\s+pattern|architectural|"
        r"should\s+i\s+use|which\s+(is|approach|pattern|framework)\s+(better|best|preferred)|"
        r"trade[-\s]?off|pros?\s+and\s+cons?|"
        r"recommend(ed|ation)?|"
        r"when\s+to\s+use|"
        r"how\s+to\s+(structure|architect|organiz)|"
        r"scalab(le|ility)|maintain(able|ability))"
    ),
    "Errors": (
        r"(error\s*:?\s*\w|exception|traceback|stack\s*trace|"
        r"throws?\s|thrown\b|raised?\b|"
        r"segfault|segmentation\s*fault|"
        r"fatal|panic|abort|core\s*dump|"
        r"compilation?\s*(error|fail)|"
        r"syntax\s*error|type\s*error|runtime\s*error|"
        r"name\s*error|value\s*error|key\s*error|"
        r"null\s*pointer|nil\s*pointer|npe|"
        r"undefined\s+is\s+not|cannot\s+read\s+propert|"
        r"unhandled\s+(promise\s+)?reject|"
        r"failed\s+to\s+(compile|build|load|import|install))"
    ),
    "Discrepancy": (
        r"(not\s+work(ing|s)?|doesn['’]?t\s+work|"
        r"unexpected(ly)?|wrong\s+(result|output|answer|value|behavior)|"
        r"incorrect(ly)?|"
        r"bug\b|broken|"
        r"instead\s+of|but\s+(i\s+)?get|but\s+(it\s+)?returns?|"
        r"supposed\s+to|expected\s+to|should\s+(return|be|have|output)|"
        r"doesn['’]?t\s+(return|match|behave|produce)|"
        r"gives?\s+(me\s+)?(wrong|incorrect|unexpected|different))"
    ),
    "API Change": (
        r"(deprecat(ed|ion)|"
        r"migrat(e|ing|ion)|"
        r"upgrade\s+(from|to)|"
        r"breaking\s+change|"
        r"version\s+\d|v\d+\.\d+|"
        r"backward[s]?\s*(in)?compat|"
        r"replac(ed|ement)\s+(by|with|for)|"
        r"no\s+longer\s+(support|available|work)|"
        r"removed\s+(in|from)|"
        r"legacy|"
        r"update[d]?\s+(to|from)\s+(version|v\d))"
    ),
    "Review": (
        r"(review\s+my|code\s+review|"
        r"improv(e|ing|ement)\s+(my|this|the)?\s*(code|performance|solution)|"
        r"optimiz(e|ing|ation)|"
        r"refactor|clean(er|up)|"
        r"is\s+(this|my)\s+(code|approach|solution)\s+(correct|good|efficient|ok)|"
        r"any\s+(better|cleaner|faster|simpler)\s+way|"
        r"more\s+(efficient|elegant|pythonic|idiomatic)|"
        r"feedback\s+on|critique)"
    ),
    "API Usage": (
        r"(how\s+(to|do\s+i|can\s+i)\s+(use|call|invoke|implement|apply|configure|set\s*up)|"
        r"usage\s+of|example\s+of|syntax\s+for|"
        r"using\s+\w+\s+(with|in|for)|"
        r"pass(ing)?\s+\w+\s+to|"
        r"import(ing)?\s+\w+|"
        r"install(ing|ation)?|"
        r"getting\s+started|quick\s*start|"
        r"documentation\s+(for|of|on))"
    ),
    "Conceptual": (
        r"(what\s+(is|are|does)|what['’]s\s+the\s+difference|"
        r"why\s+(is|does|do|are|doesn)|"
        r"how\s+(does|do|is|are)\s+\w+\s+work|"
        r"difference\s+between|"
        r"explain|understand(ing)?|"
        r"meaning\s+of|purpose\s+of|"
        r"concept(ual)?|theory|principle|"
        r"under\s+the\s+hood|internal(ly|s)?|behind\s+the\s+scene)"
    ),
    "Learning": (
        r"(tutorial|learn(ing)?|beginner|newbie|starter|"
        r"resource[s]?\s+(for|to|about)|"
        r"recommend\s+(a\s+)?(book|course|tutorial|resource)|"
        r"where\s+(to|can\s+i)\s+(learn|start|find|study)|"
        r"introduction\s+to|intro\s+to|"
        r"for\s+beginners?|new\s+to\s+\w+|"
        r"first\s+time\s+using)"
    ),
}
CATEGORIES = sorted(INTENT_PATTERNS)
AI_ERA = ["Machine-Authored Discrepancy", "Architectural Consensus"]


def _alternatives(pattern: str) -> list[str]:
    """What a pattern ``(a|b|...)`` is an alternation of."""
    found, depth, begin, at = [], 0, 1, 1
    while at < len(pattern) - 1:
        char = pattern[at]
        if char == "|" and depth == 0:
            found.append(pattern[begin:at])
            begin = at + 1
        depth += (char in "([") - (char in ")]")
        at += 2 if char == "\\" else 1
    return [*found, pattern[begin:-1]]


_UNIT = re.compile(r"\\?[^\[\]()|?*+{}]|\[[^\]]*\]")


def _head(alternative: str) -> list[str]:
    """The classes of the characters that a match surely begins with."""
    out, at = [], 0
    while (unit := _UNIT.match(alternative, at)) and alternative[unit.end() : unit.end() + 1] not in ("?", "*", "{"):
        out.append(unit[0].strip("[]"))
        at = unit.end()
        if alternative[at : at + 1] == "+":
            break
    return out


def _tree(alternatives: list[str]) -> str:
    """An alternation with common first letters taken out."""
    groups: dict[str, list[str]] = {}
    for text in alternatives:
        alone = text[:1].isalpha() and text[1:2] not in ("?", "*", "+", "{")
        groups.setdefault(text[0] if alone else "", []).append(text)
    parts = []
    for letter, own in groups.items():
        parts += own if not letter or len(own) == 1 else [f"{letter}(?:{_tree([text[1:] for text in own])})"]
    return "|".join(parts)


def searchable(pattern: str) -> str:
    """A pattern found in the same texts as ``(a|b|...)``, in one quick pass.

    A backtracking matcher tries every alternative at every place of a text. Here a place is first tested for classes of
    up to three characters, which few places pass, and then for alternatives by their first letters.
    """
    alternatives = _alternatives(pattern)
    heads = [_head(text) for text in alternatives]
    sure = min(3, *(len(head) for head in heads))
    classes = ["".join(sorted({head[at] for head in heads}, key=lambda c: (c == "-", c))) for at in range(sure)]
    ahead = "".join(f"[{c}]" for c in classes)
    return f"(?={ahead})(?:{_tree(alternatives)})" if ahead else pattern


_SEARCHED = {intent: searchable(pattern) for intent, pattern in INTENT_PATTERNS.items()}


def with_intent(rows: DataFrame, title: Column, prose: Column, name: str = "intent") -> DataFrame:
    """Add the intent of every row.

    The searched text is projected first, so that its HTML work runs once and not once per pattern.
    ASCII text, nearly all, is lowered once and searched without case folding; other text needs
    folding and the Unicode meaning of the character classes (``iU``).
    """
    texts = rows.withColumn("_text", F.concat(F.coalesce(title, F.lit("")), F.lit(" "), prose))
    is_ascii = F.octet_length("_text") == F.char_length("_text")
    lowered = texts.withColumn("_lowered", F.when(is_ascii, F.lower("_text")))
    chain = F
    for intent, pattern in _SEARCHED.items():
        found = F.coalesce(F.col("_lowered").rlike(pattern), F.col("_text").rlike("(?iU)" + pattern))
        chain = chain.when(found, intent)
    return lowered.withColumn(name, chain.otherwise(DEFAULT_INTENT)).drop("_text", "_lowered")
