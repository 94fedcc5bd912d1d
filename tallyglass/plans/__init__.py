"""Session settings, scratch storage, one-scan profiles and the named reports."""
