"""Unicode regex dialect -> java.util.regex.

Plain Java reads ``\\s``, ``\\d``, ``\\b`` and case folding as ASCII, and its
Unicode mode counts combining marks as word characters and leaves out the
separators U+001C..U+001F. The classes are therefore spelled out.
"""

SPACES = r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
SPACE_CHARS = "".join(map(chr, [
    *range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
    0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
WORD = r"[\p{L}\p{N}_]"
EDGE = rf"(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))"


def java_regex(pattern: str, ignore_case: bool = False) -> str:
    """The same language as ``pattern``, for ``Column.rlike``."""
    out, in_class, pos = [], False, 0
    while pos < len(pattern):
        pair = pattern[pos:pos + 2]
        if pair == r"\s":
            out.append(SPACES if in_class else f"[{SPACES}]")
        elif pair == r"\d":
            out.append(r"\p{Nd}")
        elif pair == r"\b":
            # At the start of a published pattern a word character always follows.
            out.append(EDGE if pos else rf"(?<!{WORD})")
        elif pair[0] == "\\":
            out.append(pair)
        else:
            in_class = pair[0] == "[" or (in_class and pair[0] != "]")
            out.append(pair[0])
            pos += 1
            continue
        pos += 2
    # A repeated group of variable length recurses once per repetition in
    # java.util.regex; the possessive form loops and accepts the same texts.
    # A group repeated before one more of itself is that group once or more, without the retries.
    again = rf"(?:[{SPACES}]+\p{{Nd}}+)*[{SPACES}]+\p{{Nd}}+"
    body = "".join(out).replace(again, rf"(?:[{SPACES}]+\p{{Nd}}+)+").replace(rf"(?:[{SPACES}]+\p{{Nd}}+)+", rf"(?:[{SPACES}]+\p{{Nd}}+)++")
    return ("(?iu)" if ignore_case else "") + body
