"""Values of arithmetic expressions in text, by one fold over their tokens.

The state is a stack of frames, one for each open bracket. A frame holds the sum so far and the
sign of the term being read, the product so far and whether the next factor divides it, the
signed operands of a chain of powers, and the sign for the next operand. Every token changes the
last frame in constant time; a closing bracket turns its frame into an operand of the frame
below. Powers bind from the right and before a sign: ``-2^2`` is -4.
"""

from pyspark.sql import functions as F

from evalmill.functions.arrays import dbl, let

TOKEN = r"(\d+(?:\.\d*)?|\.\d+|[-+*/^()×÷])"
FRAME = "struct<sum: double, sign: double, product: double, divide: boolean, powers: array<struct<base: double, sign: double>>, next: double>"
STATE = f"struct<frames: array<{FRAME}>, operand: boolean, ok: boolean>"
NO_POWERS = "array<struct<base: double, sign: double>>"


def _frame(total, sign, product, divide, powers, following):
    names = ("sum", "sign", "product", "divide", "powers", "next")
    return F.struct(*[c.alias(n) for n, c in zip(names, (total, sign, product, divide, powers, following))])


def _new_frame():
    return _frame(dbl(0), dbl(1), dbl(1), F.lit(False), F.array().cast(NO_POWERS), dbl(1))


def _power(powers):
    """b1 ^ (b2 ^ ...), each with its sign in front; 1 for none."""
    signed = lambda above, x: x["sign"] * F.when(above.isNull(), x["base"]).otherwise(F.pow(x["base"], above))
    return F.aggregate(F.reverse(powers), F.lit(None).cast("double"), signed, lambda v: F.coalesce(v, dbl(1)))


def _product(frame):
    """The product with the chain of powers that ends here; NaN for a division by zero."""
    factor = _power(frame["powers"])
    return F.when(~frame["divide"], frame["product"] * factor).otherwise(F.coalesce(F.try_divide(frame["product"], factor), F.lit(float("nan"))))


def _value(frame):
    return frame["sum"] + frame["sign"] * _product(frame)


def _with_operand(frame, value):
    one = F.array(F.struct(value.alias("base"), frame["next"].alias("sign")))
    return _frame(frame["sum"], frame["sign"], frame["product"], frame["divide"], F.concat(frame["powers"], one), dbl(1))


def _step(state, token):
    frames, operand = state["frames"], state["operand"]
    depth = F.size(frames)
    top, rest = F.element_at(frames, -1), F.slice(frames, 1, F.greatest(depth - 1, F.lit(0)))
    number = token.rlike(r"[0-9]")
    plus, times = token.isin("+", "-"), token.isin("*", "/", "×", "÷")
    sign = F.when(token == "-", dbl(-1)).otherwise(dbl(1))
    after_term = _frame(_value(top), sign, dbl(1), F.lit(False), F.array().cast(NO_POWERS), dbl(1))
    after_factor = _frame(top["sum"], top["sign"], _product(top), token.isin("/", "÷"), F.array().cast(NO_POWERS), dbl(1))
    signed = _frame(top["sum"], top["sign"], top["product"], top["divide"], top["powers"], top["next"] * sign)
    new_top = (
        F.when(number, _with_operand(top, F.when(number, token).cast("double")))
        .when(plus & operand, after_term)
        .when(plus, signed)
        .when(times, after_factor)
        .otherwise(top)
    )
    closed = F.concat(F.slice(frames, 1, F.greatest(depth - 2, F.lit(0))), F.array(_with_operand(F.element_at(rest, -1), _value(top))))
    stack = (
        F.when(token == "(", F.concat(frames, F.array(_new_frame())))
        .when(token == ")", F.when(depth > 1, closed).otherwise(frames))
        .otherwise(F.concat(rest, F.array(new_top)))
    )
    fits = F.when(number | (token == "("), ~operand).when(token == ")", operand & (depth > 1)).when(plus, F.lit(True)).otherwise(operand)
    return F.struct(stack.alias("frames"), (number | (token == ")")).alias("operand"), (state["ok"] & fits).alias("ok"))


def expression_value(text):
    """Value of an expression of numbers, + - * / ^ × ÷, signs and brackets; NULL if it is
    malformed, divides by zero or has no finite value."""
    start = F.struct(F.array(_new_frame()).alias("frames"), F.lit(False).alias("operand"), F.lit(True).alias("ok")).cast(STATE)
    step = lambda state, token: F.when(state["ok"], _step(state, token).cast(STATE)).otherwise(state)

    def finished(state):
        value = _value(F.element_at(state["frames"], -1))
        whole = state["ok"] & state["operand"] & (F.size(state["frames"]) == 1)
        return let(F.when(whole, value), lambda v: F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v))

    only_tokens = F.regexp_replace(text, TOKEN, "").rlike(r"^\s*\z")
    return F.when(only_tokens, F.aggregate(F.regexp_extract_all(text, F.lit(TOKEN)), start, step, finished))
