"""Where blocks and edges come from: relational tables, source trees and the binary wire formats."""
