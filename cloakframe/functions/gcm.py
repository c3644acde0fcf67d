"""AES-GCM over columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: AES-GCM nonce size in bytes.
NONCE_BYTES = 12


def gcm_encrypt(plain: Column, key: Column, nonce: Column, aad: Column) -> Column:
    """Ciphertext followed by its 16-byte tag. Spark puts the nonce in front; cut it off."""
    sealed = F.aes_encrypt(plain, key, F.lit("GCM"), F.lit("DEFAULT"), nonce, aad)
    return F.substr(sealed, F.lit(NONCE_BYTES + 1))


def gcm_decrypt(cipher: Column, key: Column, nonce: Column, aad: Column) -> Column:
    """Plain bytes, or NULL when authentication fails."""
    return F.try_aes_decrypt(F.concat(nonce, cipher), key, F.lit("GCM"), F.lit("DEFAULT"), aad)
