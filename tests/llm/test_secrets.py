from __future__ import annotations

from weftwork.llm.secrets import find_secrets

BODY = "aB3dE5gH7jK9mN1pQ2sT4vW6xY8zC0eF"


def test_every_issuer_prefix_is_looked_at():
    for key in ("ghu_" + BODY + "Gh12", "sk_" + "test_" + BODY, "rk_" + "test_" + BODY):
        assert [(i, s, e) for i, s, e, _ in find_secrets([f'    send("{key}")'])] == [(0, 10, 10 + len(key))]


def test_split_secret_is_followed_to_its_end():
    lines = ['password = ("q7Rt9Lm2"', '    "Vx4Kd8Wz"', '    "Hn3Pb6Ys"', '    "Jc5Gf1Tq")', 'title = "plain"']
    assert [i for i, *_ in find_secrets(lines)] == [0, 1, 2, 3]


def test_values_names_and_bodies_of_any_length():
    value = "aB3" + "xY7zQ9" * 2000
    assert find_secrets([f'password = "{value}"'])[0][1:3] == (12, 12 + len(value))
    name = "service_" * 40 + "api_key"
    assert find_secrets([f'{name} = "q7Rt9Lm2Vx4Kd8Wz"'])[0][1] == len(name) + 4
    assert find_secrets(["api_key" + " " * 300 + '= "q7Rt9Lm2Vx4Kd8Wz"'])[0][1] == 310
    pem = ["-----BEGIN PRIVATE KEY-----", "Mi9" + "aB3dE5gH7" * 40, "-----END PRIVATE KEY-----"]
    assert [i for i, *_ in find_secrets(pem)] == [0, 1, 2]
    # a public key in the same shape isn't one
    assert find_secrets([x.replace("PRIVATE", "PUBLIC") for x in pem]) == []


def test_checksums_and_signed_tokens():
    import base64
    import zlib

    from weftwork.llm import secrets as S

    body = "A" * 28 + "b9"  # too uniform to be taken by its structure alone
    n, tail = zlib.crc32(body.encode()), ""
    while n:
        n, k = divmod(n, 62)
        tail = S._DIGITS[k] + tail
    token = "ghp_" + body + tail.rjust(6, "0")
    assert S.checksum_fits("github", token) and not S.checksum_fits("github", token[:-1] + "z")
    assert [(s, e) for _, s, e, _ in find_secrets([f"use {token} here"])] == [(4, 4 + len(token))]
    head = base64.urlsafe_b64encode(b'{"alg":"HS256"}').decode().rstrip("=")
    assert S.signed_token(head + ".x.y") and not S.signed_token("eyJnope.x.y")


def test_redaction_keeps_everything_else(spark):
    from weftwork.llm import secrets as S

    lines = ["x = 1\r", f'token = "{BODY}"', None, "", f'    send("ghp_{BODY}Gh12")  # ok']
    rows = [(1, lines, "a"), (2, None, "b"), (3, [], "c"), (1, lines, "a")]
    df = spark.createDataFrame(rows, "block_id int, lines array<string>, kind string")
    out = {(r["block_id"], r["kind"]): r["lines"] for r in S.redacted(df).collect()}
    assert out[2, "b"] is None and out[3, "c"] == []
    a = out[1, "a"]
    assert a[0] == lines[0] and a[2] in (None, "") and [len(x or "") for x in a] == [len(x or "") for x in lines]
    assert a[4].startswith('    send("') and a[4].endswith('")  # ok') and BODY not in "".join(x or "" for x in a)
    assert find_secrets([x for x in a]) == [] or all(k for *_, k in find_secrets(a))
    got = [tuple(r) for r in S.secrets_in(df, ["block_id"]).select("block_id", "line_no").collect()]
    assert sorted(got) == [(1, 1), (1, 1), (1, 4), (1, 4)]
