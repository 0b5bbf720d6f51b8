"""Property tests against brute-force Python versions of the rules."""
import re

from hypothesis import given, settings, HealthCheck, strategies as st


from haulage.operators import quality
from haulage.operators.ids import allocate_ids

# The policy as the reference states it; \s is ASCII white space there (no
# Unicode classes), so it is spelled out here.
_WS = " \t\n\x0b\f\r"


def brute_outcome(p):
    p = p or ""
    if len(p.encode("utf-16-le")) // 2 < 8:  # UTF-16 code units, as the reference counts
        return "too_short"
    if not re.search(r"[0-9]", p):
        return "no_digit"
    if not re.search(r"[A-ZА-Я]", p):
        return "no_upper"
    if not re.search(rf"[^a-zA-Z0-9а-яА-Я{re.escape(_WS)}]", p):
        return "no_special"
    return "ok"


ALPHABET = "aZ09#! \t ЁёЖжЯяАа_-Ω😀𝔸"
passwords = st.lists(st.one_of(st.none(), st.text(alphabet=ALPHABET, max_size=12)), min_size=1, max_size=40)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(pw=passwords)
def test_password_policy_matches_brute_force(spark, pw):
    users = spark.createDataFrame([(i, p) for i, p in enumerate(pw)], "id_user long, password string")
    got = {r.id_user: r.outcome for r in quality.password_policy_audit(users).collect()}
    assert got == {i: brute_outcome(p) for i, p in enumerate(pw)}


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(seqs=st.sets(st.integers(-10**6, 10**6), min_size=0, max_size=300),
       base=st.integers(0, 10**9), parts=st.integers(1, 9))
def test_allocate_ids_is_row_number(spark, seqs, base, parts):
    batch = spark.createDataFrame([(s,) for s in seqs], "seq long")
    got = sorted((r.seq, r.id_x) for r in allocate_ids(batch, "id_x", ["seq"], base, parts).collect())
    assert got == [(s, base + i + 1) for i, s in enumerate(sorted(seqs))]
