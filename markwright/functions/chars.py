"""Character classes and patterns that must agree with the data's rules, in one place.

Patterns are written so that Java's regular expressions read them as meant: \\A and \\z for the ends, white space as an
explicit class (it has U+00A0, U+3000 and U+FEFF), \\d for ASCII digits only.
"""

# Fixed values.
SPACE = r"\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
S = f"[{SPACE}]"
CJK = r"[\x{3400}-\x{9FFF}]"
CHOICE_HEAD = rf"\d+{S}*[-–—]{S}*\d+{S}*[:：]"
CHOICE_HYPHEN = rf"\d+{S}*-{S}*\d+{S}*[:：]"
CHOICE_GAP = rf"[A-Z]{S}+[A-Z]"
LEAD_ONLY = rf"{S}*\d{{1,3}}[.．、]?{S}*"
SUB_QUESTION = rf"{S}*[（(][\x{{4E00}}-\x{{9FFF}}\d]+[）)]"
BACKTICK_MATH = r"`[^`\n]*(?:\$|\\|Ω|℃|°|V|A|W|N|Pa|J|kg|cm|mm|kW|h)[^`\n]*`"
CJK_MARK = "[、，；：。！？]"
MATH_FENCE = r"(?s)(\$(?<!\\\$)\$?)(.*?)(?=\$)(?<!\\)\1"
RAW_HTML = rf"<{S}*/?{S}*(?:script|iframe|object|embed|svg|style|link|meta)\b"
ANSWER_HEADING = rf"#{S}+(?:物理试卷参考答案|参考答案|答案)(?:{S}|\z)"
OPTION_LIST = r"\$([A-D](?:['′])?(?:[、，][A-D](?:['′])?)*)\$"
GRAPHIC_MARK = rf"<!--{S}*answer-graphic:{S}*(.+?){S}*-->"
LEAD_MARKED = r"\d{1,3}[.．、]"
SUB_NUMBER = r"[（(][一二三四五六七八九十\d]+[）)]"
NOT_PLAIN_START = ("#", "```", "$$", ">", "- ", "* ", "|", "![")
RETRYABLE = (408, 409, 425, 429, 500, 502, 503, 504)
DEFAULT_LINE_LIMIT = 24
ALL_RETRYABLE_FAILED = "All configured AI providers failed with retryable errors."
