"""The byte layer: CBOR, BLAKE3, codecs, signatures."""
