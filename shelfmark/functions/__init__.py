from . import fixed, hashes, identity, paths, text, variants

__all__ = ["fixed", "hashes", "identity", "paths", "text", "variants"]
