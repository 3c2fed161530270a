"""Relational operators: profiles, log digests, graphs, trees and ordered state machines as window plans."""
