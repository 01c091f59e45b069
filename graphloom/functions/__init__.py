"""Part of graphloom; see the README for what lives where."""
