"""The standard security handler: keys from passwords, ciphers, and what readers may do.

Revisions 2 to 4 with RC4 or AES-128, 5 and 6 with AES-256. The ciphers are those of
the package ``cryptography`` or of OpenSSL's library where either is there. Without them
decryption of a stream is done on all its blocks at once, encryption goes block by block,
so writing large encrypted files takes its time.
"""

from __future__ import annotations

import ctypes
import hashlib
import os
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np

try:
    from cryptography.hazmat.primitives.ciphers import Cipher, algorithms, modes
except ImportError:
    Cipher = None

from quire.functions.values import PERMISSION_BITS
from quire.sources.values import Malformed, Name, Stream

#: Fixed value: what passwords are padded with.
PAD = bytes.fromhex("28bf4e5e4e758a4164004e56fffa01082e2e00b6d0683e802f0ca9fe6453697a")


class WrongPassword(Malformed):
    """Neither the user's nor the owner's password."""


#: Where the library is that Python's own modules for hashes use.
_LIBRARIES = ("libcrypto.so.3", "libcrypto.so.1.1", "libcrypto.3.dylib")


@lru_cache(1)
def _library():
    """OpenSSL, if it can be loaded and gives what the tables here give; many small strings take it a few microseconds each."""
    for name in _LIBRARIES:
        try:
            found = ctypes.CDLL(name)
            for function in (found.AES_set_encrypt_key, found.AES_set_decrypt_key, found.AES_cbc_encrypt, found.RC4_set_key, found.RC4):
                function.restype = ctypes.c_int if function.__name__.startswith("AES_set") else None
            key, data = bytes(range(16)), bytes(range(32))
            coded = _aes_encrypt(key, key, data)
            if _cbc(found, key, key, data, 1) == coded and _cbc(found, key, key, coded, 0) == data and _stream(found, key, data) == _rc4(key, data):
                return found
        except (OSError, AttributeError):
            continue
    return None


def _cbc(library, key: bytes, iv: bytes, data: bytes, encrypt: int) -> bytes:
    schedule, out, chain = ctypes.create_string_buffer(256), ctypes.create_string_buffer(len(data) or 1), ctypes.create_string_buffer(iv, 16)
    if (library.AES_set_encrypt_key if encrypt else library.AES_set_decrypt_key)(key, 8 * len(key), schedule):
        raise Malformed("a key's length")
    library.AES_cbc_encrypt(data, out, ctypes.c_size_t(len(data)), schedule, chain, encrypt)
    return out.raw[: len(data)]


def _stream(library, key: bytes, data: bytes) -> bytes:
    state, out = ctypes.create_string_buffer(2048), ctypes.create_string_buffer(len(data) or 1)
    library.RC4_set_key(state, len(key), key)
    library.RC4(state, ctypes.c_size_t(len(data)), data, out)
    return out.raw[: len(data)]


def rc4(key: bytes, data: bytes) -> bytes:
    if not key:
        raise Malformed("a key's length")
    return _stream(library, key, data) if (library := _library()) else _rc4(key, data)


def _rc4(key: bytes, data: bytes) -> bytes:
    s, j = list(range(256)), 0
    for i in range(256):
        j = (j + s[i] + key[i % len(key)]) & 255
        s[i], s[j] = s[j], s[i]
    out, i, j = bytearray(len(data)), 0, 0
    for k, c in enumerate(data):
        i = (i + 1) & 255
        j = (j + s[i]) & 255
        s[i], s[j] = s[j], s[i]
        out[k] = c ^ s[(s[i] + s[j]) & 255]
    return bytes(out)


def _double(x: int) -> int:
    return (x << 1 ^ 0x11B if x & 128 else x << 1) & 255


def _times(a: int, b: int) -> int:
    out = 0
    while b:
        out ^= a * (b & 1)
        a, b = _double(a), b >> 1
    return out


def _boxes() -> tuple[list[int], list[int]]:
    """The substitution: the inverse in the field of 256 elements, then an affine map."""
    power, log, x = [0] * 255, [0] * 256, 1
    for i in range(255):
        power[i], log[x] = x, i
        x ^= _double(x)
    box = [0] * 256
    for a in range(256):
        inv = power[-log[a] % 255] if a else 0
        box[a] = 0x63
        for turn in range(5):
            box[a] ^= (inv << turn | inv >> (8 - turn)) & 255
    back = [0] * 256
    for a, b in enumerate(box):
        back[b] = a
    return box, back


_BOX, _BACK = _boxes()
_BACK_NP = np.array(_BACK, np.uint8)
_MUL = {k: np.array([_times(x, k) for x in range(256)], np.uint8) for k in (9, 11, 13, 14)}
_TWO = [_double(x) for x in range(256)]
#: Byte i of the shifted state comes from here, and back.
_SHIFT = [(i + 4 * (i % 4)) % 16 for i in range(16)]
_UNSHIFT = [(i - 4 * (i % 4)) % 16 for i in range(16)]


@lru_cache(64)
def _round_keys(key: bytes) -> list[bytes]:
    n, words, con = len(key) // 4, [key[i : i + 4] for i in range(0, len(key), 4)], 1
    while len(words) < 4 * (n + 7):
        w = words[-1]
        if len(words) % n == 0:
            w = bytes([_BOX[w[1]] ^ con, _BOX[w[2]], _BOX[w[3]], _BOX[w[0]]])
            con = _double(con)
        elif n > 6 and len(words) % n == 4:
            w = bytes(_BOX[c] for c in w)
        words.append(bytes(a ^ b for a, b in zip(w, words[-n], strict=True)))
    return [b"".join(words[i : i + 4]) for i in range(0, len(words), 4)]


def _compiled(key: bytes, iv: bytes):
    """The cipher of a compiled library where one is installed: the tables here manage some MB a second at most."""
    return Cipher(algorithms.AES(key), modes.CBC(iv)) if Cipher else None


def aes_decrypt(key: bytes, iv: bytes, data: bytes) -> bytes:
    """CBC without padding; all blocks at once."""
    if fast := _compiled(key, iv):
        return fast.decryptor().update(data[: len(data) // 16 * 16])
    if library := _library():
        return _cbc(library, key, iv, data[: len(data) // 16 * 16], 0)
    return _aes_decrypt(key, iv, data)


def _aes_decrypt(key: bytes, iv: bytes, data: bytes) -> bytes:
    keys = [np.frombuffer(k, np.uint8) for k in _round_keys(key)]
    blocks = np.frombuffer(data, np.uint8, len(data) // 16 * 16).reshape(-1, 16)
    s = blocks ^ keys[-1]
    for k in keys[-2::-1]:
        s = _BACK_NP[s[:, _UNSHIFT]] ^ k
        if k is not keys[0]:
            a, b, c, d = (s.reshape(-1, 4, 4)[:, :, i] for i in range(4))
            s = np.stack([_MUL[14][a] ^ _MUL[11][b] ^ _MUL[13][c] ^ _MUL[9][d], _MUL[9][a] ^ _MUL[14][b] ^ _MUL[11][c] ^ _MUL[13][d], _MUL[13][a] ^ _MUL[9][b] ^ _MUL[14][c] ^ _MUL[11][d], _MUL[11][a] ^ _MUL[13][b] ^ _MUL[9][c] ^ _MUL[14][d]], axis=2).reshape(-1, 16)
    before = np.vstack([np.frombuffer(iv, np.uint8)[None, :], blocks])[: len(blocks)]
    return (s ^ before).tobytes()


def aes_encrypt(key: bytes, iv: bytes, data: bytes) -> bytes:
    """CBC without padding."""
    if fast := _compiled(key, iv):
        return fast.encryptor().update(data)
    if library := _library():
        return _cbc(library, key, iv, data, 1)
    return _aes_encrypt(key, iv, data)


def _aes_encrypt(key: bytes, iv: bytes, data: bytes) -> bytes:
    keys, out, last = _round_keys(key), bytearray(), iv
    box, two = _BOX, _TWO
    for at in range(0, len(data), 16):
        s = [a ^ b ^ c for a, b, c in zip(data[at : at + 16], last, keys[0], strict=True)]
        for k in keys[1:-1]:
            t, s = [box[s[i]] for i in _SHIFT], []
            for i in range(0, 16, 4):
                a, b, c, d = t[i : i + 4]
                all_ = a ^ b ^ c ^ d
                s += [a ^ all_ ^ two[a ^ b] ^ k[i], b ^ all_ ^ two[b ^ c] ^ k[i + 1], c ^ all_ ^ two[c ^ d] ^ k[i + 2], d ^ all_ ^ two[d ^ a] ^ k[i + 3]]
        last = bytes(box[s[i]] ^ x for i, x in zip(_SHIFT, keys[-1], strict=True))
        out += last
    return bytes(out)


def _padded(data: bytes) -> bytes:
    n = 16 - len(data) % 16
    return data + bytes([n]) * n


def _unpadded(data: bytes) -> bytes:
    return data[: -data[-1]] if data and 1 <= data[-1] <= 16 else data


def _hash(revision: int, password: bytes, salt: bytes, user: bytes = b"") -> bytes:
    """Of revisions 5 and 6."""
    k = hashlib.sha256(password + salt + user).digest()
    if revision < 6:
        return k
    i = 0
    while True:
        e = aes_encrypt(k[:16], k[16:32], (password + k + user) * 64)
        k = (hashlib.sha256, hashlib.sha384, hashlib.sha512)[sum(e[:16]) % 3](e).digest()
        i += 1
        if i >= 64 and e[-1] <= i - 32:
            return k[:32]


def _old_key(password: bytes, o: bytes, p: int, file_id: bytes, revision: int, size: int, metadata: bool) -> bytes:
    m = hashlib.md5((password + PAD)[:32] + o[:32] + (p & 0xFFFFFFFF).to_bytes(4, "little") + file_id + (b"\xff" * 4 if revision >= 4 and not metadata else b"")).digest()
    for _ in range(50 if revision >= 3 else 0):
        m = hashlib.md5(m[:size]).digest()
    return m[:size]


def _old_user(key: bytes, revision: int, file_id: bytes) -> bytes:
    if revision == 2:
        return rc4(key, PAD)
    out = hashlib.md5(PAD + file_id).digest()
    for i in range(20):
        out = rc4(bytes(c ^ i for c in key), out)
    return out


def _owner_key(password: bytes, revision: int, size: int) -> bytes:
    m = hashlib.md5((password + PAD)[:32]).digest()
    for _ in range(50 if revision >= 3 else 0):
        m = hashlib.md5(m).digest()
    return m[:size]


@dataclass
class Handler:
    """An opened document's key and how it is used; methods are none, rc4, aes128 or aes256."""

    key: bytes
    revision: int
    permissions: int
    strings: str
    streams: str
    metadata: bool = True
    by_user: bool = False
    by_owner: bool = False

    @classmethod
    def open(cls, head: dict, file_id: bytes, password: bytes = b"") -> Handler:
        """From the document's encryption dictionary and a password of the user or the owner."""
        if head.get("/Filter") != "/Standard":
            raise Malformed("another security handler")
        v, r, o, u, p = head.get("/V", 0), head["/R"], head["/O"], head["/U"], head["/P"]
        metadata = head.get("/EncryptMetadata") is not False
        size = 5 if r == 2 else head.get("/Length", 40) // 8
        how = {"/V2": "rc4", "/AESV2": "aes128", "/AESV3": "aes256", "/None": "none"}

        def method(key: str) -> str:
            name = head.get(key, Name("/Identity"))
            return "none" if name == "/Identity" else how[head["/CF"][name]["/CFM"]]

        strings, streams = (method("/StrF"), method("/StmF")) if v >= 4 else ("rc4", "rc4")
        if r >= 5:
            password = password[:127]
            user, owner = (_hash(r, password, u[32:40]) == u[:32], _hash(r, password, o[32:40], u[:48]) == o[:32])
            if not (user or owner):
                raise WrongPassword("wrong password")
            middle = _hash(r, password, o[40:48], u[:48]) if owner else _hash(r, password, u[40:48])
            key = aes_decrypt(middle, bytes(16), (head["/OE"] if owner else head["/UE"])[:32])
            return cls(key, r, p, strings, streams, metadata, user, owner)
        size = 16 if v == 4 else size

        def fits(candidate: bytes) -> bytes | None:
            key = _old_key(candidate, o, p, file_id, r, size, metadata)
            n = 32 if r == 2 else 16
            return key if _old_user(key, r, file_id)[:n] == u[:n] else None

        mine, inner = _owner_key(password, r, size), o[:32]
        for i in range(19 if r >= 3 else 0, -1, -1):
            inner = rc4(bytes(c ^ i for c in mine), inner)
        by_user, by_owner = fits(password), fits(inner)
        if by_user is None and by_owner is None:
            raise WrongPassword("wrong password")
        return cls(by_user or by_owner, r, p, strings, streams, metadata, by_user is not None, by_owner is not None)

    def _own(self, obj: int, gen: int, method: str) -> bytes:
        if method == "aes256":
            return self.key
        raw = self.key + obj.to_bytes(3, "little") + gen.to_bytes(2, "little") + (b"sAlT" if method == "aes128" else b"")
        return hashlib.md5(raw).digest()[: min(16, len(self.key) + 5)]

    def bytes_of(self, data: bytes, obj: int, gen: int, method: str, encrypt: bool = False) -> bytes:
        if method == "none":
            return data
        key = self._own(obj, gen, method)
        if method == "rc4":
            return rc4(key, data)
        if encrypt:
            iv = hashlib.sha256(key + data).digest()[:16]  # depends on the content alone, as ids do
            return iv + aes_encrypt(key, iv, _padded(data))
        return _unpadded(aes_decrypt(key, data[:16], data[16:])) if len(data) >= 32 else b""

    def value(self, value, obj: int, gen: int, encrypt: bool = False):
        """A value with its strings and, if it is a stream, its bytes put through the cipher."""
        if isinstance(value, bytes):
            return self.bytes_of(value, obj, gen, self.strings, encrypt)
        if isinstance(value, list):
            return [self.value(v, obj, gen, encrypt) for v in value]
        if isinstance(value, dict):
            return {k: self.value(v, obj, gen, encrypt) for k, v in value.items()}
        if isinstance(value, Stream):
            kind = value.head.get("/Type")
            if kind == "/XRef":
                return value
            plain = kind == "/Metadata" and not self.metadata
            head = self.value(value.head, obj, gen, encrypt)
            return Stream(head, value.raw if plain else self.bytes_of(value.raw, obj, gen, self.streams, encrypt))
        return value

    def allowed(self) -> dict[str, bool]:
        """What a reader may do; everything for the owner."""
        return {name: self.by_owner or bool(self.permissions >> (bit - 1) & 1) for name, bit in PERMISSION_BITS.items()}


@dataclass(frozen=True)
class Encryption:
    """How a file is to be encrypted."""

    owner: str = ""
    user: str = ""
    revision: int = 6
    aes: bool = True
    metadata: bool = True
    denied: frozenset[str] = field(default_factory=frozenset)

    def problem(self) -> str | None:
        r = self.revision
        if not 2 <= r <= 6:
            return "a revision is 2 to 6"
        if self.aes and r < 4:
            return "AES needs revision 4 or more"
        if not self.metadata and r < 4:
            return "plain metadata needs revision 4 or more"
        if r >= 5 and not self.aes:
            return "revisions 5 and 6 need AES"
        if self.denied - set(PERMISSION_BITS):
            return "there is no such permission"
        if r < 5 and not (self.owner + self.user).isascii():
            return "passwords of revisions before 5 are ASCII"
        return None

    def start(self, file_id: bytes, seed: bytes = b"") -> tuple[dict, Handler]:
        """The encryption dictionary and the handler; without ``seed`` keys and salts are random."""
        if problem := self.problem():
            raise ValueError(problem)
        r, p = self.revision, -4
        for name in self.denied:
            p &= ~(1 << (PERMISSION_BITS[name] - 1))
        owner, user = (self.owner or self.user).encode(), self.user.encode()
        head = {Name("/Filter"): Name("/Standard"), Name("/R"): r, Name("/P"): p, Name("/V"): {2: 1, 3: 2, 4: 4}.get(r, 5)}
        if r >= 5:
            chance = (lambda n, k: hashlib.sha512(seed + bytes([k])).digest()[:n]) if seed else (lambda n, k: os.urandom(n))
            key = chance(32, 0)
            us, os_ = chance(16, 1), chance(16, 2)
            u = _hash(r, user, us[:8]) + us
            o = _hash(r, owner, os_[:8], u) + os_
            perms = (p & 0xFFFFFFFF).to_bytes(4, "little") + b"\xff" * 4 + (b"T" if self.metadata else b"F") + b"adb" + chance(4, 3)
            head |= {Name("/U"): u, Name("/O"): o, Name("/UE"): aes_encrypt(_hash(r, user, us[8:]), bytes(16), key), Name("/OE"): aes_encrypt(_hash(r, owner, os_[8:], u), bytes(16), key), Name("/Perms"): aes_encrypt(key, bytes(16), perms), Name("/Length"): 256}
            method = "aes256"
        else:
            size = 5 if r == 2 else 16
            o, mine = (user + PAD)[:32], _owner_key(owner, r, size)
            for i in range(20 if r >= 3 else 1):
                o = rc4(bytes(c ^ i for c in mine), o)
            key = _old_key(user, o, p, file_id, r, size, self.metadata)
            head |= {Name("/O"): o, Name("/U"): _old_user(key, r, file_id).ljust(32, b"\0"), Name("/Length"): size * 8}
            method = "aes128" if self.aes else "rc4"
        if r >= 4:
            head |= {Name("/CF"): {Name("/StdCF"): {Name("/CFM"): Name({"aes256": "/AESV3", "aes128": "/AESV2", "rc4": "/V2"}[method]), Name("/AuthEvent"): Name("/DocOpen"), Name("/Length"): len(key)}}, Name("/StmF"): Name("/StdCF"), Name("/StrF"): Name("/StdCF")}
            if not self.metadata:
                head[Name("/EncryptMetadata")] = False
        return head, Handler(key, r, p, method, method, self.metadata)
