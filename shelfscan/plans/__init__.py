"""Search plans, stop rules, platform dispatch and the rule tables."""
