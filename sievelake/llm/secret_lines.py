"""Made-up lines with secrets at known places, for the field of secrets.py to learn from and to be measured on.

A line is a sentence, a setting, a piece of code or of a log. Half of them hold a secret of one of many makes, after a name
or bare; the others hold what looks like one (hashes of commits, checksums, fingerprints, request numbers, names of
variables, dates, paths) or talk about secrets without giving one. Names and whole makes are held out of what is learnt
from, so that the field can be measured on what it has never seen.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

LETTERS, DIGITS = "abcdefghijklmnopqrstuvwxyz", "0123456789"
MIXED = LETTERS + LETTERS.upper() + DIGITS
#: Parts of made-up words, common words, names that secrets are given, and talk about them.
PARTS = "ba con der el fa gra hin ing jo ka lo mer na on per qui ra ste tion un ver wa xi yo zen th ou ea an re st ly ble".split()
COMMON = "the of and to in is that for it with as was on be at by this had not are but from or have an they which you were".split()
NAMES = ("token", "secret", "api_key", "password", "passwd", "pwd", "auth_token", "aws_access_key", "key", "client_secret", "access_token", "private_key", "passphrase", "API_TOKEN", "DB_PASSWORD", "apiKey", "credentials", "otp_secret")
HELD_OUT_NAMES = ("passcode", "signing_key", "SERVICE_TOKEN", "smtp_password", "secret_key", "bot_token")
#: What long secrets begin with, by make; a public format each.
MAKES = {"stripe": "sk_live_", "stripe test": "pk_test_", "github": "ghp_", "gitlab": "glpat-", "shop": "shpat_", "model": "sk-", "plain token": "tok_"}
HELD_OUT_MAKES = {"github app": "gho_", "chat": "xoxb-", "hub": "hf_", "package": "npm_", "cloud": "dop_v1_", "mail": "key-"}
TALK = ("reset your password today", "the secret of success is patience", "a token of thanks", "press any key to go on", "the token bucket is full", "enter the password here", "the key idea is simple", "access to the library", "no password is needed", "change the api now", "secret meetings were held", "keep the key safe", "password must have eight letters", "password policy : none", "token count : 512", "key : value", "access : public", "secret : none", "api : v2", "token expired at noon", "auth is required", "basic needs", "private rooms")


def made_lines(seed: int, n: int, names: tuple[str, ...] = NAMES, makes: dict[str, str] = MAKES) -> Iterator[tuple[str, list[tuple[int, int]]]]:
    """n lines, and where their secrets stand."""
    for line, spans, _ in made_cases(seed, n, names, makes):
        yield line, spans


def made_cases(seed: int, n: int, names: tuple[str, ...] = NAMES, makes: dict[str, str] = MAKES, only: bool = False) -> Iterator[tuple[str, list[tuple[int, int]], str]]:
    """n lines, where their secrets stand, and the make of these, with `bare` if no name leads to them. only: of long secrets none without one of the makes."""
    pick = random.Random(seed)
    one = lambda x: x[pick.randrange(len(x))]
    of = lambda chars, a, b: "".join(one(chars) for _ in range(pick.randint(a, b)))

    def word() -> str:
        return one(COMMON) if pick.random() < 0.3 else "".join(one(PARTS) for _ in range(pick.randint(1, 4)))

    def sentence() -> str:
        words = [word() for _ in range(pick.randint(2, 12))]
        if pick.random() < 0.4:
            words[0] = words[0].title()
        if pick.random() < 0.3:
            words[pick.randrange(len(words))] += one([",", ";", ":", "***", "!", "%%%", "###"])
        if pick.random() < 0.1:
            words[pick.randrange(len(words))] = f"{word()}-{word()}"
        if pick.random() < 0.12:  # shouted, with a mark or two after each word
            mark = one(["!", "!!", "!!!", "?", "", "*"])
            words = [w.upper() + mark for w in words]
        return " ".join(words) + one([".", "", "?", "!", ""])

    def plain() -> str:
        """What is no secret, though some of it looks like one."""
        return one([
            lambda: word() + of(DIGITS, 1, 3), lambda: of(DIGITS, 1, 8), lambda: f"20{of(DIGITS, 2, 2)}-0{of(DIGITS, 1, 1)}-1{of(DIGITS, 1, 1)}", lambda: of(DIGITS, 13, 16), lambda: f"/{word()}/{word()}{of(DIGITS, 1, 2)}/{word()}",
            lambda: f"{word()}_{word()}_{of(DIGITS, 1, 2)}", lambda: word().title() + word().title(), lambda: f"v{of(DIGITS, 1, 1)}.{of(DIGITS, 1, 2)}.{of(DIGITS, 1, 2)}", lambda: f"{of(DIGITS, 3, 3)}-{of(DIGITS, 4, 7)}", lambda: f"commit {of(DIGITS + 'abcdef', 7, 22)}",
            lambda: f"{one(['sha1', 'md5', 'checksum', 'digest', 'hash'])}{one([' ', ': ', ' = '])}{of(DIGITS + 'abcdef', 10, 22)}", lambda: f"{one(['id', 'request', 'uuid', 'order', 'trace'])}{one([' ', ': ', '='])}{of(DIGITS + 'abcdef', 8, 8)}-{of(DIGITS + 'abcdef', 4, 4)}-{of(DIGITS + 'abcdef', 4, 4)}",
            lambda: f"https://{word()}.{one(['com', 'org', 'net'])}/{word()}/{of(DIGITS, 1, 5)}", lambda: f"{word()}{one(['', '', '.' + word(), '.' + of(DIGITS, 1, 3)])}@{word()}{one(['', of(DIGITS, 1, 2)])}.{one(['com', 'org', 'example'])}", lambda: f"{word().upper()}{of(DIGITS, 2, 4)}", lambda: f"{word()}({word()}, {of(DIGITS, 1, 2)});", lambda: f"{one(DIGITS)}.{of(DIGITS, 1, 4)}%", lambda: f"+{of(DIGITS, 2, 2)} {of(DIGITS, 3, 4)} {of(DIGITS, 6, 7)}",
            lambda: f"{word()}{one([' = ', '=', ': '])}{one([word(), of(DIGITS, 1, 5), 'true', 'null'])}",
            lambda: f"{one(['', '', 'host key ', 'key fingerprint ', 'public key ', 'key '])}{one(['SHA256:', 'SHA256:', 'SHA1:', 'fingerprint ', 'ssh-rsa ', 'integrity sha512-', 'sha256-', 'ETag: '])}{of(MIXED + '+/', 27, 44)}", lambda: f"MD5:{':'.join(of(DIGITS + 'abcdef', 2, 2) for _ in range(8))}", lambda: f"{word()}-{word()}-{word()}_{of(DIGITS, 1, 3)}", lambda: f"{word()}_{word()}_{word()}_{word()}",
        ])()

    def value() -> str:
        """A secret that stands by itself: long, and of no language."""
        nonlocal make
        if only or pick.random() < 0.4:
            make = one(list(makes))
            return made_by(make)
        make = "long"
        return one([lambda: of(MIXED, 20, 44), lambda: of(MIXED + "_-", 24, 40), lambda: of(MIXED + "+/", 28, 44), lambda: f"eyJ{of(MIXED, 16, 30)}.eyJ{of(MIXED, 16, 40)}.{of(MIXED + '_-', 20, 40)}", lambda: of(DIGITS + "abcdef", 24, 64)])()

    def made_by(name: str) -> str:
        """Its beginning, and letters and digits, in parts for some."""
        parts = one([lambda: of(MIXED, 20, 40), lambda: of(MIXED, 20, 40), lambda: of(DIGITS + "abcdefABCDEF", 24, 40), lambda: f"{of(DIGITS, 10, 12)}-{of(DIGITS, 10, 13)}-{of(MIXED, 20, 24)}"])()
        # of those to learn from, most begin as nothing else does, so that no beginning is learnt by heart
        begin = makes[name] if only or makes is not MAKES or pick.random() < 0.3 else f"{of(LETTERS, 2, 6)}{one('_-')}{one(['', '', f'{of(LETTERS, 2, 4)}_'])}"
        return begin + parts

    def short() -> str:
        """A secret that only its place gives away."""
        return one([lambda: word() + of(DIGITS, 1, 4), lambda: "".join(word() for _ in range(4)), lambda: of(LETTERS.upper() + "234567", 16, 16), lambda: f"{word()}{one('@!$#')}{word()}{of(DIGITS, 1, 3)}", lambda: f"{word().title()}{of(DIGITS, 2, 4)}{one('!?$#')}", lambda: of(MIXED, 8, 14), lambda: of(DIGITS + "abcdef", 10, 22), lambda: of(LETTERS, 8, 16)])()

    make = ""
    for _ in range(n):
        make = ""
        line, spans, kind = " ".join(one([sentence, plain])() for _ in range(pick.randint(0, 3))), [], pick.random()
        line += " " if line else ""
        if kind < 0.08:
            make = one(list(makes))
            secret, make = made_by(make), f"{make}, bare"
            spans.append((len(line), len(line + secret)))
            line += secret + one(["", "", ",", ".", ")"])
        elif kind < 0.5:
            if kind < 0.42:
                name = one(names)
                lead = one([f"{name}{one([' = ', '=', ': ', ':', ' := '])}", f'"{name}": ', f"{name} is " if pick.random() < 0.2 else f"{name}=", f"{name} ", f"export {name}="])
                quote = one(["", '"', "'"]) if not lead.endswith("is ") and not lead.endswith(f"{name} ") else ""
                secret = one([value, short])() if lead[-2:-1] not in "s" and lead != f"{name} " else one([value, lambda: word() + of(DIGITS, 1, 4), lambda: f"{word().title()}{of(DIGITS, 2, 4)}{one('!$#')}"])()
            else:
                lead, quote = one(["Authorization: Bearer ", "bearer ", "Bearer ", "Authorization: Basic ", f"https://{word()}:"]), ""
                secret = short() if lead.startswith("https") else value()
                if lead.startswith("https"):
                    secret = secret.replace("@", "!")
            start = len(line + lead + quote)
            make = make or "short"
            spans.append((start, start + len(secret)))
            line += lead + quote + secret + quote + (f"@{word()}.com" if lead.startswith("https") else one(["", ",", ";", "", ""]) if quote else "")
        elif kind < 0.65:
            line += one(TALK)
        yield line + (" " + " ".join(one([sentence, plain])() for _ in range(pick.randint(0, 2)))).rstrip(), spans, make if spans else ""
