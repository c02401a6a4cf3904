"""Mixed models from distributed statistics; boosted trees and Shapley values."""
