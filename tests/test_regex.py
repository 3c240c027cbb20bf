"""Dialects, classes, properties and quirks, through Java's engine."""

import pytest

from glyphstream.functions.regex import UnsupportedRegex, compile_regex, least_length, parse
from glyphstream.functions.unicode_sets import UnicodeSet, by_category, by_name

HITS = [
    # dialect, pattern, line, hit
    ("pcre", "a.c", "xabcx", True),
    ("pcre", "^b", "ab", False),
    ("pcre", "b$", "ab", True),
    ("pcre", "x{2,3}{2}", "xxxx", True),
    ("pcre", "^x{2}{2}$", "xxx", False),
    ("pcre", "x{,2}y", "y", True),
    ("pcre", "(ab)+?c", "ababc", True),
    ("pcre", "^a++b", "aab", True),
    ("pcre", "(?#note)q", "q", True),
    ("pcre", "(?i)straSSe", "STRASSE", True),
    ("pcre", "a(?i:B)c", "abc", True),
    ("pcre", "a(?i:B)c", "abC", False),
    ("pcre", "(?|a|b)c", "bc", True),
    ("pcre", "(?<=x)y(?!z)", "xyw", True),
    ("pcre", "(?<=x)y(?!z)", "xyz", False),
    ("pcre", r"\bend\b", "the end.", True),
    ("pcre", r"\Bnd\b", "the end", True),
    ("pcre", r"\x41\x{42}C\u{44}\U00000045\o{106}\0107", "ABCDEFG", True),
    ("pcre", r"[\x{61}-c]+d", "abcd", True),
    ("pcre", "[]a]", "]", True),
    ("pcre", "[^]a]", "]", False),
    ("pcre", "[a-]x", "-x", True),
    ("pcre", "[[a-z]--[aeiou]]{3}", "xyz", True),
    ("pcre", "^[[a-z]--[aeiou]]$", "e", False),
    ("pcre", "^[[a-z]&&[x-z]]$", "y", True),
    ("pcre", "[[:digit:][:upper:]]", "q7", True),
    ("pcre", "^[[:^alpha:]]$", "a", False),
    ("pcre", r"\p{Lu}\p{Letter}\p{script=Greek}", "Aaα", True),
    ("pcre", r"\p{greek}", "λ", True),
    ("pcre", r"\P{L}", "a", False),
    ("pcre", r"\p{script=/^hira/}", "ひ", True),
    ("pcre", r"\p{ea=W}", "漢", True),
    ("pcre", r"\N{LATIN SMALL LETTER E}", "e", True),
    ("pcre", r"^\N{GREEK SMALL LETTER (ALPHA|BETA)$}+$", "αβ", True),
    ("pcre", r"(?\p{upper}:[a-zA-Z]{2})", "xAB", True),
    ("pcre", r"(?\p{upper}:[a-zA-Z]{2})", "aBc", False),
    ("pcre", r"\b{script=Hiragana}", "aひ", True),
    ("pcre", r"(\w+)-\1", "ab-ab", True),
    ("pcre", r"^(\w)-\1$", "a-b", False),
    ("pcre", r"^\X$", "é", True),
    ("pcre", r"(?g)e$", "é", False),
    ("pcre", r"a\qb".replace("q", "y"), "ayb", True),
    ("pcre", "(?x)a b c", "abc", True),
    ("ere", "a|b+", "xbb", True),
    ("ere", r"\<end", "the end", True),
    ("ere", r"[\d]", "d", True),
    ("ere", "(?:a)".replace("?:", ""), "a", True),
    ("bre", r"a\|b", "b", True),
    ("bre", "a|b", "a|b", True),
    ("bre", r"\(ab\)\{2\}", "abab", True),
    ("bre", "(ab)", "(ab)", True),
    ("bre", "*a", "*a", True),
    ("bre", r"x\+y\?z", "xxz", True),
    ("prosite", "N-{P}-[ST]-{P}.", "ANASQ", True),
    ("prosite", "N-{P}-[ST]-{P}.", "NPSQ", False),
    ("prosite", "<M-x(2,3)-K>", "MAAK", True),
    ("prosite", "<M-x(2)-K", "AMAAK", False),
    ("fixed", "a.c", "abc", False),
    ("fixed", "a.c", "xa.c", True),
]


@pytest.mark.parametrize("dialect,pattern,line,hit", HITS)
def test_dialects(spark, dialect, pattern, line, hit):
    java = spark._jvm.java.util.regex.Pattern.compile(compile_regex(pattern, dialect).java)
    assert java.matcher(line).find() is hit


@pytest.mark.parametrize("pattern", ["(?>a)", "(?s)a", r"\b{w}", r"\Qa\E", "a(", "[a", "*a", r"\2", r"\p{Nonsense}", "x{3,2}", "a\\"])
def test_rejected(pattern):
    with pytest.raises(UnsupportedRegex):
        compile_regex(pattern)


def test_rewrites_keep_the_answer(spark):
    plain = lambda p: spark._jvm.java.util.regex.Pattern.compile("(?U)" + p)
    lines = ["", "a", "aab", "foo", "xfoox", "aaaaaaaaaaaaaaaaaaaaaaaaaaaa!", "b" * 30]
    for p in (".*foo.*", "(?:a*)*b", "(?:a|b*)*c?foo", "x?a*", "(?:a+)+!"):
        own = spark._jvm.java.util.regex.Pattern.compile(compile_regex(p).java)
        assert [own.matcher(x).find() for x in lines] == [plain(p).matcher(x).find() for x in lines], p
    assert compile_regex(".*foo.*").java == "(?U)foo"


def test_least_length():
    assert least_length(parse("ab{2,3}(c|de)f?")) == 4


def test_word_and_whole_line(spark):
    find = lambda r, x: spark._jvm.java.util.regex.Pattern.compile(r.java).matcher(x).find()
    assert find(compile_regex("of", word=True), "a of b") and not find(compile_regex("of", word=True), "often")
    assert find(compile_regex("a|b", whole_line=True), "b") and not find(compile_regex("a|b", whole_line=True), "ab")


def test_unicode_sets():
    a, b = UnicodeSet.of([(97, 122)]), UnicodeSet.of("aeiou")
    assert len(a - b) == 21 and (a & b) == b and (a ^ b) == a - b and len(~a) == 0x110000 - 26
    assert ~~a == a and "e" in b and "x" not in b and len(a | UnicodeSet.of([48])) == 27
    assert len(by_category("Zs")) >= 17 and "α" in by_name("^GREEK SMALL LETTER ALPHA$")
