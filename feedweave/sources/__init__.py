"""Reading documents: decoding, lexing and fetching."""
