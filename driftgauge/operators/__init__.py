"""DataFrame operators of a scan: matching, findings, suppressions, gates."""
