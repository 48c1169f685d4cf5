"""Multi-step evaluations: protocols, audits and gates."""
