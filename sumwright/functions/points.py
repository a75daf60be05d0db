"""The equality of ``functions.equivalence`` over a batch of pairs, by numpy.

The same test by the same rules, with all pairs of a batch evaluated step by step together. Only programs
of plain form are decided: known operations, whole steps, arguments without brackets and outer whitespace,
no arithmetic on a comparison. The others, and pairs without a value at a point, stay undecided.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from sumwright.functions.equivalence import GENERATOR, ORDER, PRIME, SEEDS
from sumwright.functions.program_text import ARITHMETIC_OPS, EOF, TABLE_OPS

# Numbers of the operations in the order of ``ARITHMETIC_OPS``; 0 is none, table operations follow.
ADD, SUBTRACT, MULTIPLY, DIVIDE, EXP, GREATER = range(1, 7)
_OPS = {f"{op}(".encode(): i for i, op in enumerate(ARITHMETIC_OPS + TABLE_OPS, 1)}

# What a token may be as an argument: a row's name of a table step alone, a reference, a literal.
OTHER, NAME, REFERENCE, LITERAL = range(4)
# Visible ASCII alone, as most literals are.
_VISIBLE = r"""^[!"$-'*-{}~]+$"""
_NAME = re.compile(r"[^|()\s](?:[^|()]*[^|()\s])?")
_REFERENCE = re.compile(rb"#[0-9]{1,9}")

# Byte by byte, the powers of the generator.
_POWERS = np.array([[pow(GENERATOR, byte << low, PRIME) for byte in range(256)] for low in range(0, 32, 8)], np.uint64)


def _mod(x: np.ndarray, modulus: int = PRIME) -> np.ndarray:
    # A quotient by a constant is vectorised, a remainder is not.
    modulus = np.uint64(modulus)
    return x - x // modulus * modulus


def _mul(x: np.ndarray, y: np.ndarray, modulus: int = PRIME) -> np.ndarray:
    return _mod(x * y, modulus)


def inverses(x: np.ndarray, modulus: int = PRIME) -> np.ndarray:
    """Inverses modulo a prime; that of 0 is 0."""
    out = x.copy()
    at = np.flatnonzero(x > 1)
    if len(at):
        base = x[at]
        made = base
        for bit in format(modulus - 2, "b")[1:]:
            made = _mul(made, made, modulus)
            if bit == "1":
                made = _mul(made, base, modulus)
        out[at] = made
    return out


def generated(exponent: np.ndarray) -> np.ndarray:
    """The generator to powers below ORDER."""
    made = None
    for i, powers in enumerate(_POWERS):
        chosen = powers[(exponent >> np.uint64(8 * i)) & np.uint64(255)]
        made = chosen if made is None else _mul(made, chosen)
    return made


def _scrambled(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit over all (the finish of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _symbol(kind: str, seed: int, *parts: np.ndarray) -> np.ndarray:
    """64 bits named by a kind of symbol, a point and numbers."""
    key = hashlib.blake2b(f"{kind}|{seed}".encode(), digest_size=8).digest()
    made = np.uint64(int.from_bytes(key, "little"))
    for part in parts:
        made = _scrambled(made ^ part) * np.uint64(0x9E3779B97F4A7C15)
    return _scrambled(made)


class _Programs:
    """The steps of all programs of a batch one after another, gold before predicted.

    A value's place is that of a name, or ``names`` plus that of a step.
    """

    def __init__(self, lists: list[pa.Array], positional_tables: bool):
        flat = pa.concat_arrays([x.flatten() for x in lists]).dictionary_encode()
        size = np.concatenate([pc.fill_null(pc.list_value_length(x), 0).to_numpy() for x in lists]).astype(np.int64)
        begins = np.cumsum(size) - size
        self._read_tokens(flat.dictionary)
        code = pc.fill_null(flat.indices, self.tokens - 1).to_numpy(zero_copy_only=False).astype(np.int64)

        ends = np.zeros(len(size), bool)
        whole = (size >= 5) & (size % 4 == 1)
        ends[whole] = self.is_end[code[begins[whole] + size[whole] - 1]]
        self.count = np.where(ends, size // 4, 0)
        self.start = np.cumsum(self.count) - self.count
        self.program = np.repeat(np.arange(len(size)), self.count)
        nth = np.arange(len(self.program)) - self.start[self.program]
        at = begins[self.program] + 4 * nth
        op, a, b = self.op_of[code[at]], code[at + 1], code[at + 2]
        is_table = op > GREATER
        self.op, self.text = op, (code[at], a, b)

        fine = (op > 0) & self.is_close[code[at + 3]]
        fine &= np.where(is_table, (self.kind[a] > OTHER) & (self.kind[b] > OTHER), (self.kind[a] > NAME) & (self.kind[b] > NAME))
        self.plain = ends & ~self._any(~fine)

        # Table steps are names like literals, told apart by all they hold.
        tables, place = np.flatnonzero(is_table), (nth == 0) & positional_tables
        held = np.stack([op, a, b, place])[:, tables]
        key = np.ravel_multi_index(held, (len(_OPS) + 1, self.tokens, self.tokens, 2))
        _, first, which = np.unique(key, return_index=True, return_inverse=True)
        self.tables = held[:, first]
        self.names = self.tokens + len(first)

        self.a, self.b = a, b
        self.table = np.full(len(op), -1)
        self.table[tables] = self.tokens + which
        beyond, compared = np.zeros(len(op), bool), np.zeros(len(op), bool)
        for name, token in (("a", a), ("b", b)):
            refers = np.flatnonzero(~is_table & (self.kind[token] == REFERENCE))
            to = self.reference[token[refers]]
            ahead = to >= nth[refers]
            beyond[refers] |= ahead
            step = self.start[self.program[refers]] + np.where(ahead, 0, to)
            compared[refers] |= ~ahead & (op[step] == GREATER)
            index = token.copy()
            index[refers] = self.names + step
            setattr(self, name, index)
        self.beyond = self._any(beyond)
        self.plain &= ~self._any(compared)
        self.powers = self._any(op == EXP)

    def _read_tokens(self, dictionary: pa.Array) -> None:
        words = pc.cast(dictionary, pa.large_binary())
        # The last one stands for null.
        tokens = [*words.to_pylist(), b""]
        self.tokens = n = len(tokens)
        self.op_of, self.kind, self.reference = (np.zeros(n, np.int64) for _ in range(3))
        self.is_end, self.is_close = np.zeros(n, bool), np.zeros(n, bool)
        visible = pc.match_substring_regex(words, _VISIBLE).to_numpy(zero_copy_only=False)
        self.kind[:-1][visible] = LITERAL
        for i in np.flatnonzero(~visible):
            token = tokens[i]
            if token in _OPS:
                self.op_of[i] = _OPS[token]
            elif token == b")":
                self.is_close[i] = True
            elif _REFERENCE.fullmatch(token):
                self.kind[i], self.reference[i] = REFERENCE, int(token[1:])
            elif _NAME.fullmatch(token.decode("utf-8", "surrogateescape")):
                self.kind[i] = NAME if b"#" in token else LITERAL
        if EOF.encode() in tokens:
            self.is_end[tokens.index(EOF.encode())] = True
        # Of every token, 64 bits for each point, and as many for exponents.
        digests = [hashlib.blake2b(token, digest_size=16 * len(SEEDS)).digest() for token in tokens]
        self.digests = np.frombuffer(b"".join(digests), "<u8").reshape(n, 2 * len(SEEDS)).astype(np.uint64)

    def _any(self, steps: np.ndarray) -> np.ndarray:
        """Whether a program has such a step."""
        return np.bincount(self.program[steps], minlength=len(self.count)) > 0

    def used(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The names that programs use: programs and names."""
        steps = np.flatnonzero(rows[self.program])
        is_table = self.table[steps] >= 0
        found = [(steps[is_table], self.table[steps[is_table]])]
        for index in (self.a, self.b):
            literal = steps[~is_table & (index[steps] < self.names)]
            found.append((literal, index[literal]))
        places, names = (np.concatenate(x) for x in zip(*found, strict=True))
        return self.program[places], names

    def symbols(self, point: int, part: int) -> np.ndarray:
        """64 bits for every name at a point, of values (part 0) or of exponents (part 1)."""
        own = self.digests[:, 2 * point + part]
        op, a, b, place = self.tables
        rows = _symbol(f"row {part}", SEEDS[point], op.astype(np.uint64), own[a], own[b], place.astype(np.uint64))
        return np.concatenate([own, rows])

    def evaluate(self, programs: np.ndarray, point: int, powers: bool) -> dict[str, np.ndarray]:
        """The last values of programs: quotient ``n, d``, whether a comparison, and whether to trust it."""
        seed, total = SEEDS[point], self.names + len(self.op)
        one = np.uint64(1)

        def column(part: int, modulus: int) -> tuple[np.ndarray, np.ndarray]:
            values, below = np.zeros(total, np.uint64), np.ones(total, np.uint64)
            values[: self.names] = self.symbols(point, part) % np.uint64(modulus)
            return values, below

        value, below = column(0, PRIME)
        upper, lower = column(1, ORDER) if powers else (None, None)
        truth, doubt = np.zeros(total, bool), np.zeros(len(self.count), bool)

        def quotient(op, n, d, a, b, modulus):
            xn, xd, yn, yd = n[a], d[a], n[b], d[b]
            crossed, across = _mul(xn, yd, modulus), _mul(yn, xd, modulus)
            made = np.where(op == ADD, crossed + across, np.where(op == SUBTRACT, crossed + (np.uint64(modulus) - across), crossed))
            made = _mod(np.where(op == MULTIPLY, xn * yn, made), modulus)
            return made, _mul(xd, np.where(op == DIVIDE, yn, yd), modulus)

        start, count = self.start[programs], self.count[programs]
        begin, left = start, count
        for k in range(int(count.max(initial=0))):
            begin, left = begin[left > k], left[left > k]
            step = begin + k
            op, at = self.op[step], self.names + step
            a, b = self.a[step], self.b[step]
            table = np.flatnonzero(op > GREATER)
            # Of a table step, the operands are tokens of their own; its value is put in below.
            value[at], below[at] = quotient(op, value, below, a, b, PRIME)
            if powers:
                upper[at], lower[at] = quotient(op, upper, lower, a, b, ORDER)
            if len(table):
                names = self.table[step[table]]
                value[at[table]], below[at[table]] = value[names], one
                if powers:
                    upper[at[table]], lower[at[table]] = upper[names], one
            for kind in (EXP, GREATER):
                own = np.flatnonzero(op == kind)
                if not len(own):
                    continue
                to, x, y = at[own], a[own], b[own]
                valid = below[to] != 0
                # Without a value, until the valid ones are put in.
                value[to], below[to] = one, np.where(valid, one, 0)
                if powers:
                    upper[to], lower[to] = one, one
                to, x, y = to[valid], x[valid], y[valid]
                x_value, y_value = (_mul(value[i], inverses(below[i])) for i in (x, y))
                if kind == GREATER:
                    made = _symbol("greater", seed, x_value, y_value) % np.uint64(PRIME)
                    # A value is never greater than itself, whatever it is.
                    value[to], truth[to] = np.where(x_value == y_value, np.uint64(0), made), True
                    continue
                doubt[self.program[to[(lower[x] == 0) | (lower[y] == 0)] - self.names]] = True
                x_lower, y_lower = (_mul(upper[i], inverses(lower[i], ORDER), ORDER) for i in (x, y))
                exponent = _mul(_symbol("base", seed, x_value) % np.uint64(ORDER), y_lower, ORDER)
                made = generated(exponent)
                trivial, same = (y_value == 0) | (x_value == 1), y_value == 1
                value[to] = np.where(trivial, one, np.where(same, x_value, made))
                named = _symbol("exponent", seed, made) % np.uint64(ORDER)
                upper[to] = np.where(trivial, one, np.where(same, x_lower, named))
        last = self.names + start + count - 1
        return {"n": value[last], "d": below[last], "truth": truth[last], "doubt": doubt[programs]}


def equal_pairs(gold: pa.Array, pred: pa.Array, positional_tables: bool = False) -> pa.Array:
    """What ``equal_program`` says of each pair of token lists; null where it is to be asked itself."""
    pairs = len(gold)
    programs = _Programs([gold, pred], positional_tables)
    plain = programs.plain[:pairs] & programs.plain[pairs:]
    both = np.concatenate([plain, plain])

    owner, name = programs.used(both)
    key = owner % pairs * programs.names + name if pairs else owner
    own = owner < pairs
    new = owner[~own][~np.isin(key[~own], key[own])] - pairs
    admissible = plain & ~programs.beyond[:pairs] & ~programs.beyond[pairs:]
    admissible[new] = False

    # Token by token: joined text would take 1, 23 for 12, 3.
    alike = np.flatnonzero(admissible & (programs.count[:pairs] == programs.count[pairs:]))
    identical = np.zeros(2 * pairs, bool)
    identical[alike] = True
    ours = np.flatnonzero(identical[programs.program])
    theirs = ours + (programs.start[pairs:] - programs.start[:pairs])[programs.program[ours]]
    differs = np.any([text[ours] != text[theirs] for text in programs.text], axis=0)
    identical[programs.program[ours[differs]]] = False
    identical = identical[:pairs]

    decided, equal = plain.copy(), identical.copy()
    powers = programs.powers[:pairs] | programs.powers[pairs:]
    for with_powers in (False, True):
        active = np.flatnonzero(admissible & ~identical & (powers == with_powers))
        for point in range(len(SEEDS)):
            if not len(active):
                break
            found = programs.evaluate(np.concatenate([active, active + pairs]), point, with_powers)
            (gn, pn), (gd, pd), (gt, pt), (gs, ps) = (np.split(found[x], 2) for x in ("n", "d", "truth", "doubt"))
            unknown = (gd == 0) | (pd == 0) | gs | ps
            decided[active[unknown]] = False
            active = active[~unknown & (gt == pt) & (_mul(gn, pd) == _mul(pn, gd))]
        equal[active] = True
    return pa.array(equal, mask=~decided)
