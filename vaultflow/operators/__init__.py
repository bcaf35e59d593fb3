"""Jobs over pages, links, sign-offs, logs and versions."""
