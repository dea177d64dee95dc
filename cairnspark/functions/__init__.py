"""Part of cairnspark."""
