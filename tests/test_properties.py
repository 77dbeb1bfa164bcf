from hypothesis import given, settings
from hypothesis import strategies as st

from graphlog.functions import fingerprints
from graphlog.sources import terse
from graphlog.sources.log import items_of
from graphlog.wire import aes, cbor, codecs
from graphlog.wire.blake3 import blake3

VALUES = st.recursive(
    st.none() | st.booleans() | st.integers(-(2**70), 2**70) | st.floats(allow_nan=False) | st.binary(max_size=20) | st.text(max_size=20),
    lambda inner: st.lists(inner, max_size=4) | st.dictionaries(st.text(max_size=5) | st.integers(0, 99), inner, max_size=4),
    max_leaves=12,
)


@given(VALUES)
@settings(deadline=None, max_examples=150)
def test_cbor_round_trip(x):
    assert cbor.loads(cbor.dumps(x)) == x
    assert cbor.dumps(cbor.loads(cbor.dumps(x))) == cbor.dumps(x)


@given(st.binary(max_size=200))
@settings(deadline=None, max_examples=150)
def test_any_bytes_scan(data):
    rows = list(items_of("x", data))
    assert rows
    assert [r[1] for r in rows] == list(range(len(rows)))


def test_heads_of_any_form():
    assert cbor.loads(bytes.fromhex("5f42010243030405ff")) == b"\1\2\3\4\5"
    assert cbor.loads(bytes.fromhex("9f018202039f0405ffff")) == [1, [2, 3], [4, 5]]
    assert cbor.loads(bytes.fromhex("bf61610161629f0203ffff")) == {"a": 1, "b": [2, 3]}
    assert cbor.sequence(b"\x01\x18") == ([(0, 1, 1)], 1)


def test_blake3_sizes():
    """Chunks one by one and many at once agree at every border."""
    from graphlog.wire import blake3 as module

    data = bytes(i % 251 for i in range(20_000))
    assert blake3(data[:102400])[:4] == blake3(data)[:4]
    for n in (0, 1, 63, 64, 65, 1023, 1024, 1025, 8192, 8193, 9216, 9217, 16_385):
        many = blake3(data[:n])
        saved, module._many_chunks = module._many_chunks, lambda x: [module._compress(*module._chunk(x[i * 1024 : (i + 1) * 1024], i))[:8] for i in range(len(x) // 1024)]
        try:
            assert blake3(data[:n]) == many
        finally:
            module._many_chunks = saved
    assert blake3(b"", 100)[:32] == blake3(b"")
    assert blake3(b"").hex() == "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262"


@given(st.binary(max_size=70), st.binary(max_size=30))
@settings(deadline=None, max_examples=15)
def test_sealing(data, aad):
    key, iv = bytes(range(32)), bytes(12)
    sealed = aes.seal(key, iv, data, aad)
    assert aes.open_(key, iv, sealed, aad) == data
    assert aes.open_(key, iv, sealed[:-1] + bytes([sealed[-1] ^ 1]), aad) is None


@given(st.binary(max_size=3000), st.sampled_from([["gzip"], ["zstd"], ["zstd-rsyncable"], ["identity", "gzip", "zstd"], []]))
@settings(deadline=None, max_examples=40)
def test_codec_chains(data, chain):
    assert codecs.decode([codecs.Codec(n, "compress") for n in chain], codecs.encode(chain, data)) == data


@given(st.text(max_size=40), st.sampled_from([None, "en", "ar"]))
@settings(deadline=None, max_examples=150)
def test_literals_round_trip(text, lang):
    token = terse.literal(text, None, lang)
    assert terse.atom(token)["lex"] == text
    if not any(0xD800 <= ord(c) < 0xE000 for c in text):
        assert terse.parse(f"<http://s> <http://p> {token} .", "ntriples") == [("<http://s>", "<http://p>", token, None)]
        inner = f"<<( <http://s> <http://p> {token} )>>"
        assert terse.split_triple(f"<<( <http://a> <http://b> {inner} )>>") == ("<http://a>", "<http://b>", inner)


@given(st.integers(0, 2**48 - 1), st.integers(0, 2**80 - 1))
def test_ulids(ms, low):
    assert fingerprints.parse_ulid(fingerprints.ulid(ms, low)) == (ms, low)
