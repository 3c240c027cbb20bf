"""Patterns of five dialects (Perl-style, POSIX extended and basic, PROSITE, fixed) as Java patterns.

The text is parsed into small nodes, the nodes are simplified, and a Java pattern for RLIKE comes out:
user text never reaches Java unparsed.  Patterns are meant for single lines.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from glyphstream.functions.unicode_sets import by_name, by_property, loose, value_names

BREAKS = r"\n\x0B\f\r\x{85}\x{2028}\x{2029}"
DIALECTS = ("pcre", "ere", "bre", "prosite", "fixed")


class UnsupportedRegex(ValueError):
    """The pattern is malformed, or asks for something that has no meaning here."""


@dataclass(frozen=True)
class Node:
    pass


@dataclass(frozen=True)
class Cls(Node):  # one sign out of a Java class
    java: str
    fold: bool = False


@dataclass(frozen=True)
class Raw(Node):  # Java text of no fixed width
    java: str


@dataclass(frozen=True)
class Seq(Node):
    items: tuple


@dataclass(frozen=True)
class Alt(Node):
    items: tuple


@dataclass(frozen=True)
class Rep(Node):
    item: Node
    low: int
    high: int | None


@dataclass(frozen=True)
class Look(Node):
    sign: str  # = ! <= <!
    item: Node


@dataclass(frozen=True)
class Group(Node):
    item: Node
    number: int


ANY, START, END, EMPTY = Cls(f"[^{BREAKS}]"), Raw("^"), Raw("\\z"), Seq(())
WORD = Cls("\\w")


def seq(items) -> Node:
    flat = tuple(y for x in items for y in (x.items if isinstance(x, Seq) else (x,)))
    return flat[0] if len(flat) == 1 else Seq(flat)


def alt(items) -> Node:
    """Alternatives without repeats; single signs become one class."""
    flat = list(dict.fromkeys(y for x in items for y in (x.items if isinstance(x, Alt) else (x,))))
    if len(flat) > 1 and all(isinstance(x, Cls) for x in flat) and len({x.fold for x in flat}) == 1:
        return Cls("[" + "".join(x.java for x in flat) + "]", flat[0].fold)
    return flat[0] if len(flat) == 1 else Alt(tuple(flat))


def nullable(n: Node) -> bool:
    match n:
        case Seq(items):
            return all(map(nullable, items))
        case Alt(items):
            return any(map(nullable, items))
        case Rep(item, low, _):
            return low == 0 or nullable(item)
        case Group(item, _):
            return nullable(item)
        case Cls():
            return False
    return False


def rep(item: Node, low: int, high: int | None) -> Node:
    """Repetition, with star normal form: in x*, what x may skip isn't skipped again."""
    if high == 0:
        return EMPTY
    if (low, high) == (1, 1):
        return item
    if isinstance(item, Rep) and high is None and item.high is None and item.low <= 1:
        return Rep(item.item, 0 if low == 0 or item.low == 0 else item.low * max(low, 1), None)
    if high is None and isinstance(item, Alt):
        item = alt(x.item if isinstance(x, Rep) and x.high is None and x.low <= 1 and low == 0 else x for x in item.items)
    if high is None and low == 0 and isinstance(item, Rep) and (item.low, item.high) == (0, 1):
        item = item.item
    return Rep(item, low, high)


def strip_ends(n: Node) -> Node:
    """For line selection: parts that may be empty at either end of a pattern can't change the answer."""
    items = list(n.items) if isinstance(n, Seq) else [n]
    skip = lambda x: isinstance(x, Rep) and x.low == 0 and not has_groups(x)
    while items and skip(items[0]):
        items.pop(0)
    while items and skip(items[-1]):
        items.pop()
    return seq(items)


def has_groups(n: Node) -> bool:
    match n:
        case Group():
            return True
        case Seq(items) | Alt(items):
            return any(map(has_groups, items))
        case Rep(item, _, _) | Look(_, item):
            return has_groups(item)
    return False


def least_length(n: Node) -> int:
    """Signs that a match has at least."""
    match n:
        case Cls():
            return 1
        case Seq(items):
            return sum(map(least_length, items))
        case Alt(items):
            return min(map(least_length, items))
        case Rep(item, low, _):
            return low * least_length(item)
        case Group(item, _):
            return least_length(item)
    return 0


def emit(n: Node) -> str:
    match n:
        case Cls(java, fold):
            return f"(?iu:{java})" if fold else java
        case Raw(java):
            return java
        case Seq(items):
            return "".join(f"(?:{emit(x)})" if isinstance(x, Alt) else emit(x) for x in items)
        case Alt(items):
            return "|".join(map(emit, items))
        case Rep(item, low, high):
            own = emit(item) if isinstance(item, (Cls, Group)) else f"(?:{emit(item)})"
            tail = {(0, None): "*", (1, None): "+", (0, 1): "?"}.get((low, high)) or (f"{{{low}}}" if low == high else f"{{{low},{'' if high is None else high}}}")
            return own + tail
        case Look(sign, item):
            return f"(?{sign}{emit(item)})"
        case Group(item, _):
            return f"({emit(item)})"
    raise TypeError(n)


def literal(c: str, fold: bool = False) -> Cls:
    return Cls(c if c.isascii() and c.isalnum() else f"\\x{{{ord(c):X}}}", fold)


#: POSIX class names, in Java's terms under (?U).
POSIX = {"alnum": "\\p{Alnum}", "alpha": "\\p{Alpha}", "blank": "\\p{Blank}", "cntrl": "\\p{Cntrl}", "digit": "\\d", "graph": "\\p{Graph}", "lower": "\\p{Lower}", "print": "\\p{Print}", "punct": "\\p{Punct}", "space": "\\s", "upper": "\\p{Upper}", "word": "\\w", "xdigit": "\\p{XDigit}"}
#: Long names of general categories.
CATEGORIES = {"letter": "L", "casedletter": "LC", "uppercaseletter": "Lu", "lowercaseletter": "Ll", "titlecaseletter": "Lt", "modifierletter": "Lm", "otherletter": "Lo", "mark": "M", "nonspacingmark": "Mn", "spacingmark": "Mc", "enclosingmark": "Me", "number": "N", "decimalnumber": "Nd", "letternumber": "Nl", "othernumber": "No", "punctuation": "P", "connectorpunctuation": "Pc", "dashpunctuation": "Pd", "openpunctuation": "Ps", "closepunctuation": "Pe", "initialpunctuation": "Pi", "finalpunctuation": "Pf", "otherpunctuation": "Po", "symbol": "S", "mathsymbol": "Sm", "currencysymbol": "Sc", "modifiersymbol": "Sk", "othersymbol": "So", "separator": "Z", "spaceseparator": "Zs", "lineseparator": "Zl", "paragraphseparator": "Zp", "other": "C", "control": "Cc", "format": "Cf", "surrogate": "Cs", "privateuse": "Co", "unassigned": "Cn"}
#: Binary properties that Java knows (its Hex_Digit has all decimal digits, so that one comes from elsewhere).
BINARY = {"alphabetic": "Alphabetic", "alpha": "Alphabetic", "ideographic": "Ideographic", "ideo": "Ideographic", "uppercase": "Uppercase", "upper": "Uppercase", "lowercase": "Lowercase", "lower": "Lowercase", "whitespace": "White_Space", "wspace": "White_Space", "space": "White_Space", "joincontrol": "Join_Control", "joinc": "Join_Control", "noncharactercodepoint": "Noncharacter_Code_Point", "nchar": "Noncharacter_Code_Point", "assigned": "Assigned"}
#: Scripts that patterns may select by a pattern over their names.
SCRIPTS = "Adlam Ahom Anatolian_Hieroglyphs Arabic Armenian Avestan Balinese Bamum Bassa_Vah Batak Bengali Bhaiksuki Bopomofo Brahmi Braille Buginese Buhid Canadian_Aboriginal Carian Caucasian_Albanian Chakma Cham Cherokee Common Coptic Cuneiform Cypriot Cyrillic Deseret Devanagari Duployan Egyptian_Hieroglyphs Elbasan Ethiopic Georgian Glagolitic Gothic Grantha Greek Gujarati Gurmukhi Han Hangul Hanunoo Hatran Hebrew Hiragana Imperial_Aramaic Inherited Inscriptional_Pahlavi Inscriptional_Parthian Javanese Kaithi Kannada Katakana Kayah_Li Kharoshthi Khmer Khojki Khudawadi Lao Latin Lepcha Limbu Linear_A Linear_B Lisu Lycian Lydian Mahajani Malayalam Mandaic Manichaean Marchen Meetei_Mayek Mende_Kikakui Meroitic_Cursive Meroitic_Hieroglyphs Miao Modi Mongolian Mro Multani Myanmar Nabataean New_Tai_Lue Newa Nko Ogham Ol_Chiki Old_Hungarian Old_Italic Old_North_Arabian Old_Permic Old_Persian Old_South_Arabian Old_Turkic Oriya Osage Osmanya Pahawh_Hmong Palmyrene Pau_Cin_Hau Phags_Pa Phoenician Psalter_Pahlavi Rejang Runic Samaritan Saurashtra Sharada Shavian Siddham SignWriting Sinhala Sora_Sompeng Sundanese Syloti_Nagri Syriac Tagalog Tagbanwa Tai_Le Tai_Tham Tai_Viet Takri Tamil Tangut Telugu Thaana Thai Tibetan Tifinagh Tirhuta Ugaritic Vai Warang_Citi Yi".split()
_SCRIPT = {loose(s): s for s in SCRIPTS}


def property_class(spec: str, negate: bool = False) -> str:
    """A Java class for \\p{spec}: category, script, block, binary, POSIX name, or value by /pattern/."""
    name, eq, value = spec.partition("=")
    if not eq and ":" in spec:
        name, eq, value = spec.partition(":")
    if name.startswith("^"):
        name, negate = name[1:], not negate
    key, low, found = loose(name), loose(value), None
    if value[:1] == "/" and value[-1:] == "/":
        names = property_values(key, value[1:-1])
        found = "[" + "".join(property_class(f"{name}={v}") for v in names) + "]" if names else "[^\\x{0}-\\x{10FFFF}]"
    elif eq and key in ("gc", "generalcategory"):
        found = property_class(value)
    elif eq and key in ("sc", "script") and low in _SCRIPT:
        found = f"\\p{{script={_SCRIPT[low]}}}"
    elif eq and key in BINARY:
        found = property_class(name, low in ("n", "no", "f", "false"))
    elif not eq:
        if key == "any":
            found = "[\\x{0}-\\x{10FFFF}]"
        elif key == "ascii":
            found = "\\p{ASCII}"
        elif key in POSIX and key not in ("alpha", "upper", "lower", "space"):
            found = POSIX[key]
        elif key in CATEGORIES:
            found = f"\\p{{{CATEGORIES[key]}}}"
        elif len(key) <= 2 and key.capitalize() in {*CATEGORIES.values()} or key == "lc":
            found = f"\\p{{{'LC' if key == 'lc' else key.capitalize()}}}"
        elif key in BINARY:
            found = f"\\p{{Is{BINARY[key]}}}"
        elif key in _SCRIPT:
            found = f"\\p{{script={_SCRIPT[key]}}}"
    if found is None:
        own = by_property(spec)
        if own is None:
            raise UnsupportedRegex(f"unknown property {spec}")
        found = own.java()
    return f"[^{found}]" if negate else found


def property_values(key: str, pattern: str) -> list[str]:
    """Names of the property's values that have a match of the pattern, compared loosely; an unknown property is an error."""
    test = re.compile(pattern.replace("_", "").replace(" ", ""), re.I)
    names = SCRIPTS if key in ("sc", "script") else [*CATEGORIES] if key in ("gc", "generalcategory") else value_names(key)
    if names is None:
        raise UnsupportedRegex(f"unknown property {key}")
    return [n for n in names if test.search(loose(n))]


def reverse(n: Node) -> Node:
    """The node that matches just the reversed texts."""
    match n:
        case Seq(items):
            return Seq(tuple(map(reverse, reversed(items))))
        case Alt(items):
            return Alt(tuple(map(reverse, items)))
        case Rep(item, low, high):
            return Rep(reverse(item), low, high)
        case Group(item, number):
            return Group(reverse(item), number)
        case Look(sign, item):
            return Look({"=": "<=", "<=": "=", "!": "<!", "<!": "!"}[sign], reverse(item))
        case Cls():
            return n
    if n in (START, END):
        return END if n == START else START
    raise UnsupportedRegex(f"{emit(n)} can't be reversed")


@dataclass
class Flags:
    fold: bool = False
    grapheme: bool = False
    spacing: bool = False
    unix: bool = False


class Parser:
    """Perl-style, extended and basic syntax; they differ in which signs are special bare and which escaped."""

    def __init__(self, text: str, dialect: str, flags: Flags):
        self.s, self.i, self.dialect, self.flags, self.groups = text, 0, dialect, flags, 0
        self.pcre = dialect == "pcre"

    def peek(self, token: str) -> bool:
        """token as an operator of the dialect at this place."""
        if self.dialect == "bre" and token in "(){}+?|":
            return self.s.startswith("\\" + token, self.i)
        return self.s.startswith(token, self.i)

    def eat(self, token: str) -> bool:
        if self.peek(token):
            self.i += 2 if self.dialect == "bre" and token in "(){}+?|" else len(token)
            return True
        return False

    def need(self, token: str) -> None:
        if not self.eat(token):
            raise UnsupportedRegex(f"{token} expected at {self.i} in {self.s!r}")

    def parse(self) -> Node:
        out = self.alternatives()
        if self.i < len(self.s):
            raise UnsupportedRegex(f"unexpected {self.s[self.i]!r} at {self.i} in {self.s!r}")
        return out

    def alternatives(self) -> Node:
        saved, out = replace(self.flags), [self.sequence()]
        while self.eat("|"):
            out.append(self.sequence())
        self.flags = saved
        return alt(out)

    def sequence(self) -> Node:
        out = []
        while self.i < len(self.s) and not self.peek("|") and not self.peek(")"):
            if self.flags.spacing and self.s[self.i] == " ":
                self.i += 1
                continue
            item = self.item(not out)
            if item is None:
                continue
            item = self.quantified(item)
            if self.flags.grapheme and isinstance(item, Cls):
                item = seq([item, Raw("\\b{g}")])
            out.append(item)
        return seq(out)

    def quantified(self, item: Node) -> Node:
        while True:
            if self.eat("*"):
                low, high = 0, None
            elif self.eat("+"):
                low, high = 1, None
            elif self.eat("?"):
                low, high = 0, 1
            elif self.peek("{") and (m := re.compile(r"(\d*)(,?)(\d*)" + (r"\\\}" if self.dialect == "bre" else r"\}")).match(self.s, self.i + (2 if self.dialect == "bre" else 1))) and (m[1] or m[3]):
                self.i = m.end()
                low = int(m[1] or 0)
                high = low if not m[2] else int(m[3]) if m[3] else None
                if high is not None and high < low:
                    raise UnsupportedRegex(f"bounds of {m[0]}")
            else:
                return item
            once, item = item, rep(item, low, high)
            if self.pcre and self.eat("?"):
                pass  # laziness selects the same lines
            elif self.pcre and self.peek("+") and self.s[self.i - 1] in "*+?}":
                self.i += 1
                if low != high:
                    item = seq([item, Look("!", once)])

    def item(self, first: bool) -> Node | None:
        c = self.s[self.i]
        if self.eat("("):
            return self.group()
        if c == "^" and (self.dialect != "bre" or first):
            self.i += 1
            return START
        if c == "$" and (self.dialect != "bre" or self.i + 1 == len(self.s) or self.s.startswith(("\\)", "\\|"), self.i + 1)):
            self.i += 1
            return END
        if c == ".":
            self.i += 1
            return ANY
        if c == "[":
            self.i += 1
            return Cls(self.bracket(), self.flags.fold)
        if c == "\\":
            return self.escape()
        if c == "*" and first and self.dialect == "bre":
            self.i += 1
            return literal(c)
        if c in "*+?" and self.peek(c):
            raise UnsupportedRegex(f"nothing to repeat at {self.i} in {self.s!r}")
        self.i += 1
        return literal(c, self.flags.fold)

    def group(self) -> Node | None:
        if not (self.pcre and self.eat("?")):
            self.groups += 1
            number, body = self.groups, self.alternatives()
            self.need(")")
            return Group(body, number)
        if self.eat("#"):
            self.i = self.s.index(")", self.i) + 1
            return None
        for sign in ("<=", "<!", "=", "!"):
            if self.eat(sign):
                body = self.alternatives()
                self.need(")")
                return Look(sign, body)
        if self.eat(":") or self.eat("|"):
            body = self.alternatives()
            self.need(")")
            return body
        if self.eat(">"):
            raise UnsupportedRegex("atomic groups")
        if m := re.compile(r"\\([pP])\{([^}]*)\}:").match(self.s, self.i):
            self.i = m.end()
            body = self.alternatives()
            self.need(")")
            only = Look("=", Cls(property_class(m[2], m[1] == "P")))
            within = lambda n: seq([only, n]) if isinstance(n, Cls) else replace(n, items=tuple(map(within, n.items))) if isinstance(n, (Seq, Alt)) else replace(n, item=within(n.item)) if isinstance(n, (Rep, Group)) else n
            return within(body)
        m = re.compile(r"([a-zA-Z]*)(?:-([a-zA-Z]*))?([:)])").match(self.s, self.i)
        if not m:
            raise UnsupportedRegex(f"group at {self.i} in {self.s!r}")
        saved, self.i = replace(self.flags), m.end()
        for letters, on in ((m[1], True), (m[2] or "", False)):
            for x in letters:
                if x not in "igmxd":
                    raise UnsupportedRegex(f"mode flag {x}")
                name = {"i": "fold", "g": "grapheme", "x": "spacing", "d": "unix"}.get(x)
                if name:
                    setattr(self.flags, name, on)
        if m[3] == ")":
            return None
        body = self.alternatives()
        self.need(")")
        self.flags = saved
        return body

    def escape(self) -> Node:
        s, i = self.s, self.i + 1
        if i >= len(s):
            raise UnsupportedRegex("pattern ends with a backslash")
        c = s[i]
        if self.pcre:
            if c in "dDsSwW":
                self.i += 2
                return Cls(f"\\{c}")
            if c in "bB":
                if m := re.compile(r"\{([^}]*)\}").match(s, i + 1):
                    self.i = m.end()
                    if m[1] == "g":
                        return Raw("\\b{g}" if c == "b" else "(?!\\b{g})")
                    if m[1] in "wls":
                        raise UnsupportedRegex(f"boundary {m[1]}")
                    return boundary(Cls(property_class(m[1])), c == "b")
                self.i += 2
                return boundary(WORD, c == "b")
            if c in "qQ":
                raise UnsupportedRegex(f"\\{c}")
            if c in "123456789":
                if int(c) > self.groups:
                    raise UnsupportedRegex(f"no group {c}")
                self.i += 2
                return Raw(f"(?iu:\\{c})" if self.flags.fold else f"(?:\\{c})")
            if c == "X":
                self.i += 2
                return Raw("\\X")
        elif c in "<>":
            self.i += 2
            return Look("<!" if c == "<" else "!", WORD)
        elif c in "bB":
            self.i += 2
            return boundary(WORD, c == "b")
        elif c in "wWsS":
            self.i += 2
            return Cls(f"\\{c}")
        elif c in "123456789" and int(c) <= self.groups:
            self.i += 2
            return Raw(f"(?:\\{c})")
        own = self.class_escape()
        return Cls(own, self.flags.fold)

    def class_escape(self) -> str:
        """A Java class for the escape at this place: a property, a name, or a single sign."""
        s, i = self.s, self.i + 1
        if self.pcre:
            if m := re.compile(r"([pP])(?:\{([^}]*)\}|(\w))").match(s, i):
                self.i = m.end()
                return property_class(m[2] if m[2] is not None else m[3], m[1] == "P")
            if m := re.compile(r"N\{([^}]*)\}").match(s, i):
                self.i = m.end()
                try:
                    return literal(unicodedata.lookup(m[1])).java
                except KeyError:
                    return by_name(m[1].upper()).java()
            if s[i] in "dDsSwW":
                self.i += 2
                return f"\\{s[i]}"
        return literal(self.sign()).java

    def sign(self) -> str:
        s, i = self.s, self.i + 1
        if not self.pcre:
            self.i += 2
            return s[i]
        for pattern, base in ((r"x\{([0-9a-fA-F]+)\}", 16), (r"x([0-9a-fA-F]{1,2})", 16), (r"u\{([0-9a-fA-F]+)\}", 16), (r"u([0-9a-fA-F]{4})", 16), (r"U([0-9a-fA-F]{8})", 16), (r"o\{([0-7]+)\}", 8), (r"0([0-7]{0,3})", 8)):
            if m := re.compile(pattern).match(s, i):
                self.i = m.end()
                code = int(m[1] or "0", base)
                if code > 0x10FFFF:
                    raise UnsupportedRegex(f"code point {code:X}")
                return chr(code)
        if s[i] == "c" and i + 1 < len(s):
            self.i += 3
            return chr(ord(s[i + 1].upper()) ^ 64)
        self.i += 2
        return {"a": "\a", "e": "\x1b", "f": "\f", "n": "\n", "r": "\r", "t": "\t", "v": "\v"}.get(s[i], s[i])

    def bracket(self) -> str:
        """The class after its opening bracket, as Java text."""
        s = self.s
        negate = s.startswith("^", self.i)
        self.i += negate
        out, first = [], True
        while True:
            if self.i >= len(s):
                raise UnsupportedRegex("unclosed class")
            c = s[self.i]
            if c == "]" and not first:
                self.i += 1
                break
            if self.pcre and s.startswith(("&&", "--", "&[", "-["), self.i) and out and not (c == "-" and s.startswith("--]", self.i)):
                both = s[self.i + 1] in "&-"
                self.i += 2
                # the right side is all that follows with doubled signs, else the class in brackets
                if both:
                    right, out_negated = self.rest(), None
                else:
                    right, out_negated = self.bracket(), None
                out = [f"[{''.join(out)}&&{right}]" if c == "&" else f"[{''.join(out)}&&[^{right}]]"]
                first = False
                continue
            if m := re.compile(r"\[:(\^?)(\w+):\]").match(s, self.i):
                if m[2].lower() not in POSIX:
                    raise UnsupportedRegex(m[0])
                self.i = m.end()
                own = POSIX[m[2].lower()]
                out.append(f"[^{own}]" if m[1] else own)
                first = False
                continue
            if c == "[" and self.pcre:
                self.i += 1
                out.append(self.bracket())
                first = False
                continue
            single = None
            if c == "\\" and self.pcre:
                if s[self.i + 1 : self.i + 2] and s[self.i + 1] in "pPNdDsSwW":
                    out.append(self.class_escape())
                    first = False
                    continue
                single = "\b" if s[self.i + 1 : self.i + 2] == "b" else None
                single = single or self.sign()
                if single == "\b":
                    self.i += 2
            else:
                single = c
                self.i += 1
            first = False
            if s.startswith("-", self.i) and self.i + 1 < len(s) and s[self.i + 1] not in "]" and not s.startswith(("--", "-["), self.i):
                self.i += 1
                end = self.sign() if s[self.i] == "\\" and self.pcre else s[self.i]
                if s[self.i - 1] == "-" and end == s[self.i]:
                    self.i += 1
                if ord(end) < ord(single):
                    raise UnsupportedRegex(f"range {single}-{end}")
                out.append(f"\\x{{{ord(single):X}}}-\\x{{{ord(end):X}}}")
            else:
                out.append(f"\\x{{{ord(single):X}}}")
        return f"[^{''.join(out)}]" if negate else f"[{''.join(out)}]"

    def rest(self) -> str:
        """What stands before the next operator or the end of the class."""
        start, depth, i = self.i, 0, self.i
        while i < len(self.s):
            if self.s[i] == "\\":
                i += 2
                continue
            if not depth and (self.s[i] == "]" or self.s.startswith(("&&", "--"), i)):
                break
            depth += (self.s[i] == "[") - (self.s[i] == "]")
            i += 1
        inner = Parser(self.s[start:i] + "]", self.dialect, self.flags)
        out = inner.bracket()
        self.i = i
        return out


def boundary(of: Cls, is_one: bool) -> Node:
    edge = alt([seq([Look("<=", of), Look("!", of)]), seq([Look("<!", of), Look("=", of)])])
    return edge if is_one else alt([seq([Look("<=", of), Look("=", of)]), seq([Look("<!", of), Look("!", of)])])


def parse_prosite(text: str) -> Node:
    out = []
    for part in text.strip().removesuffix(".").split("-"):
        m = re.fullmatch(r"(<?)(?:([A-Z])|(x)|\[([A-Z<>]+)\]|\{([A-Z]+)\})(?:\((\d+)(?:,(\d+))?\))?(>?)", part.strip())
        if not m:
            raise UnsupportedRegex(f"PROSITE element {part!r}")
        if m[1]:
            out.append(START)
        end = m[4] and ">" in m[4]
        own = literal(m[2]) if m[2] else ANY if m[3] else Cls(f"[{m[4].strip('<>')}]") if m[4] else Cls(f"[^{m[5]}{BREAKS}]")
        item = rep(own, int(m[6]), int(m[7] or m[6])) if m[6] else own
        out.append(alt([item, END]) if end else item)
        if m[8]:
            out.append(END)
    return seq(out)


def parse(text: str, dialect: str = "pcre", ignore_case: bool = False) -> Node:
    if dialect == "prosite":
        return parse_prosite(text)
    if dialect == "fixed":
        return seq([literal(c, ignore_case) for c in text])
    if dialect not in DIALECTS:
        raise UnsupportedRegex(f"dialect {dialect}")
    return Parser(text, dialect, Flags(fold=ignore_case)).parse()


@dataclass(frozen=True)
class CompiledRegex:
    """A pattern ready for use on a column of lines."""

    java: str
    least: int
    plain: str | None = None  # the text itself, if it is only that

    def predicate(self, line: Column) -> Column:
        if self.plain is not None:
            return line.contains(self.plain)
        return line.rlike(self.java)


def compile_regex(patterns: str | list[str], dialect: str = "pcre", *, ignore_case: bool = False, word: bool = False, whole_line: bool = False, select_only: bool = True) -> CompiledRegex:
    """One pattern that matches where any of the given ones does.

    select_only says that only whether a line matches counts, so ends that may be empty are dropped.
    """
    texts = [patterns] if isinstance(patterns, str) else list(patterns)
    nodes = [parse(t, dialect, ignore_case) for t in texts]
    if len(texts) == 1 and dialect == "fixed" and not (ignore_case or word or whole_line):
        return CompiledRegex(emit(nodes[0]), len(texts[0]), texts[0])
    if word:
        nodes = [seq([boundary(WORD, True), n, boundary(WORD, True)]) for n in nodes]
    if whole_line:
        nodes = [seq([START, n, END]) for n in nodes]
    elif select_only and not word:
        nodes = [strip_ends(n) for n in nodes]
    node = alt(nodes) if not any(map(has_groups, nodes)) or len(nodes) == 1 else Alt(tuple(nodes))
    return CompiledRegex("(?U)" + emit(node), least_length(node))


def any_of(*predicates: Column) -> Column:
    out = F.lit(False)
    for p in predicates:
        out = out | p
    return out
