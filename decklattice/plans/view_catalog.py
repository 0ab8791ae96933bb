"""Every training view by source and name: its cell, label table and columns.

``cells.build_view(VIEWS["gwent_cards"]["TypeMaskDojo"], rows, cards, decks)`` builds one. Closed
classes that a label table already has (heroes, leaders, masked cards, encounters) are not repeated
here: ``dataclasses.replace`` gives a view a list of its own.
"""

from __future__ import annotations

from ..operators.cells import Group, View
from .catalog import MASKED, Label

OTHER = "OTHER"

# Label classes, caps and least counts of views.
COPIES = tuple(str(i) for i in range(1, 10)) + ("10+",)
ENDINGS = ("province", "colony", "multi_pile")
RANKS = ("bronze", "silver", "gold", "platinum", "diamond", "mythic", OTHER)
CHARACTERS = ("CHARACTER.DEFECT", "CHARACTER.IRONCLAD", "CHARACTER.NECROBINDER", "CHARACTER.REGENT", "CHARACTER.SILENT", OTHER)
TIERS = ("tier_1", "tier_2", "tier_3", "tier_4", "special")
MOST_TURNS, MOST_ACTIONS, LEAST_PICKS = 50.0, 30.0, 10

DECK = (Group("deck", "deck_uuid"),)
DECK_PAIR = (Group("deck", "deck_uuid_lo"), Group("deck", "deck_uuid_hi"))
KINGDOM = Group("deck", "kingdom_uuid")
PARTIAL = Group("deck", "partial_deck_uuid")
CARD_IN_KINGDOM = (Group("card", "card_uuid"), KINGDOM)
SUPPLY = Group("deck", "kingdom_uuid", distinct=True)  # of decks to which the base supply was added


def masked_views(game: str, fields: dict[str, str], names: dict[str, str] | None = None) -> dict[str, View]:
    """A view for each masked label of a game; ``fields`` says which field each label is read from."""

    def view(metric: str, x: Label) -> View:
        cell = {"masked_number": "card_number", "masked_set": "card_labels"}.get(x.kind, "card_class")
        classes = x.classes + (OTHER,) if cell == "card_class" else x.classes
        return View(cell, metric, "labels" if cell == "card_labels" else "label", classes=classes, masks=fields[metric])

    return {(names or {}).get(m, m.replace("Metric", "Dojo")): view(m, x) for m, x in MASKED[game].items()}


def card_numbers(labels: dict[str, str], cap: float | None = None) -> dict[str, View]:
    return {f"{n}Dojo": View("card_number", f"{n}Metric", column, cap=cap) for n, column in labels.items()}


def deck_numbers(labels: dict[str, str], prefix: str = "") -> dict[str, View]:
    return {f"{prefix}{n}Dojo": View("group_number", f"{n}Metric", column, groups=DECK) for n, column in labels.items()}


def held_out(metric: str) -> View:
    """Candidates with the card that was taken out of a deck, and the rest of the deck without any copy of it."""
    rest = Group("deck", "deck_uuid", without="target_card_uuid")
    return View("options", metric, "target_card_uuid", groups=(Group("cards", "candidate_uuids", distinct=True), rest))


def masked_from_deck(metric: str) -> View:
    """A deck without any copy of one card, and that card's class."""
    return View("group_class", metric, groups=(Group("deck", "deck_uuid", without="target_card_uuid"),))


def run_pick(metric: str, can_skip: bool = False) -> View:
    return View("options", metric, "picked_uuid", groups=(Group("cards", "offered_uuids", distinct=True), Group("cards", "deck_uuids", may_be_empty=True)), can_skip=can_skip, split_by="run_id")


VIEWS: dict[str, dict[str, View]] = {
    "final_decks": {f"{g}HeldOutCardDojo": held_out(f"{g}HeldOutCardMetric") for g in ("Pokemon", "FleshAndBlood", "Gwent", "Dominion", "SlayTheSpire2", "Mtg")},
    "spire_cards": masked_views("spire", {"CostMaskMetric": "cost", "CardTypeMaskMetric": "type", "RarityMaskMetric": "rarity", "ColorMaskMetric": "color"}),
    "gwent_cards": masked_views("gwent", {f"{n}MaskMetric": n.lower() for n in ("Color", "Faction", "Rarity", "Set", "Type", "Power", "Armor", "Provision")}),
    "pokemon_cards": masked_views("pokemon", {"HpRegressionMetric": "hp", "TypesMaskMetric": "types", "StageMaskMetric": "subtypes", "RetreatCostRegressionMetric": "convertedRetreatCost", "WeaknessMaskMetric": "weaknesses"}),
    "hearthstone_cards": masked_views("hearthstone", {"CostRegressionMetric": "cost", "AttackRegressionMetric": "attack", "HealthRegressionMetric": "health", "ClassMaskMetric": "cardClass", "RarityMaskMetric": "rarity", "CardTypeMaskMetric": "type", "RacesMaskMetric": "races", "SpellSchoolMaskMetric": "spellSchool"}),
    "mtg_cards": masked_views("mtg", {"CmcRegressionMetric": "cmc", "CardTypeMaskMetric": "type_line", "RarityMaskMetric": "rarity", "ColorsMaskMetric": "colors", "PowerRegressionMetric": "power", "ToughnessRegressionMetric": "toughness"}),
    "flesh_and_blood_cards": masked_views("flesh_and_blood", {"PitchMaskMetric": "pitch", "CostRegressionMetric": "cost", "PowerRegressionMetric": "power", "DefenseRegressionMetric": "defense", "ClassMaskMetric": "typebox", "CardTypeMaskMetric": "typebox"}),
    "dominion_cards": masked_views("dominion", {"CostRegressionMetric": "cost", "TypeMaskMetric": "types", "SetMaskMetric": "cardset_tags"}),
    "cross_game": {"RarityTierDojo": View("card_class", "RarityTierMetric", classes=TIERS, balance_by="source_game", masks="rarity")},
    "flesh_and_blood_decks": card_numbers({"CardInclusionRate": "inclusion_rate"})
    | {"HeroConditionedInclusionDojo": View("card_curve", "HeroConditionedInclusionMetric", "inclusion_rate_by_hero", counts="legal_deck_count_by_hero", least=1), "HeroMaskedFromDeckDojo": masked_from_deck("HeroMaskedFromDeckMetric")},
    "gwent_decks": card_numbers({"CardInclusionRate": "inclusion_rate"})
    | deck_numbers({"GuideVotes": "signed_log_votes"})
    | {"FactionConditionedInclusionDojo": View("card_curve", "FactionConditionedInclusionMetric", "inclusion_rate_by_faction", counts="legal_deck_count_by_faction", least=1), "LeaderMaskedFromDeckDojo": masked_from_deck("LeaderMaskedFromDeckMetric")},
    "runs": card_numbers({
        "CardRelicCount": "average_relic_count", "CardTotalDamageTaken": "average_total_damage_taken", "CardDeckSize": "average_deck_size", "CardTotalCardsPicked": "average_total_cards_picked", "CardTotalTurns": "average_total_turns",
        "CardElitesKilled": "average_elites_killed", "CardFloorsCleared": "average_floors_cleared", "CardTotalCombats": "average_total_combats", "CardWinRate": "win_rate", "CardUpgradeRate": "upgrade_rate", "CardWinRateAtAct2": "win_rate",
    })
    | deck_numbers({
        "RelicCount": "relic_count", "TotalDamageTaken": "total_damage_taken", "TotalCardsPicked": "total_cards_picked", "TotalCardsSkipped": "total_cards_skipped", "TotalTurns": "total_turns", "ElitesKilled": "elites_killed",
        "FloorsCleared": "floors_cleared", "TotalCombats": "total_combats",
    }, "Deck")
    | {
        "DeckAscensionDojo": View("group_number", "AscensionPredictionMetric", "ascension", groups=DECK),
        "CardCharacterPredictionDojo": View("card_shares", "CardCharacterPredictionMetric", classes=CHARACTERS),
        "WinDojo": View("group_bit", "WinMetric", "win", groups=DECK),
        "CharacterDojo": View("group_class", "CharacterPredictionMetric", "character", groups=DECK, classes=CHARACTERS),
        "KilledByDojo": View("group_class", "KilledByMetric", "killed_by", groups=DECK),
    },
    "run_picks": {
        "CardRewardPickDojo": run_pick("CardRewardPickMetric", can_skip=True), "CardRemovalPickDojo": run_pick("CardRemovalPickMetric"),
        "CardUpgradePickDojo": run_pick("CardUpgradePickMetric"), "ShopPurchasePickDojo": run_pick("ShopPurchasePickMetric"),
    },
    "limited_games": card_numbers({
        "WinRateWhenInDeck": "win_rate_when_in_deck", "OpeningHandWinRate": "opening_hand_win_rate", "DrawnWinRate": "drawn_win_rate", "GameLengthAssociation": "game_length_association", "OnPlayWinRateDelta": "on_play_win_rate_delta",
        "TutorChoiceRate": "tutor_choice_rate", "TutorTargetRate": "tutor_target_rate",
    })
    | deck_numbers({"DeckGameLengthPrediction": "num_turns", "OnPlayWinRateSensitivityByDeck": "on_play_win_rate_sensitivity"})
    | {"DeckWinPredictionDojo": View("group_bit", "DeckWinPredictionMetric", "won", groups=DECK), "DeckRankTierPredictionDojo": View("group_class", "DeckRankTierPredictionMetric", "rank", groups=DECK, classes=RANKS)},
    "limited_replays": card_numbers({
        "AverageTurnCast": "average_turn_cast", "CastRate": "cast_rate", "DiscardRate": "discard_rate", "CombatKillInvolvementRate": "combat_kill_involvement_rate", "CombatDamagePushThroughRate": "combat_damage_push_through_rate",
        "TurnsToGameEndAfterCast": "turns_to_game_end_after_cast", "TutorTargetRate": "tutor_target_rate",
    })
    | deck_numbers({"CombatAggressionProfile": "combat_aggression_profile"})
    | {"AttackerBlockerCombatOutcomeDojo": View("group_number", "AttackerBlockerCombatOutcomeMetric", "net_kill_delta", groups=(Group("cards", "attacker_uuids"), Group("cards", "blocker_uuids", may_be_empty=True)))},
    "drafts": card_numbers({"CardTakeRate": "take_rate", "FirstPickRate": "take_rate", "RankStratifiedTakeRate": "take_rate"})
    | {
        "PackToPickChoiceSetDojo": View("options", "PackToPickChoiceSetMetric", "pick_uuid", groups=(Group("cards", "pack_option_uuids", distinct=True),)),
        "PoolConditionedPickDojo": View("options", "PoolConditionedPickMetric", "pick_uuid", groups=(Group("cards", "pack_option_uuids", distinct=True), Group("cards", "pool_uuids", may_be_empty=True))),
        "PickNumberDecayCurveDojo": View("card_curve", "PickNumberDecayCurveMetric", "take_rate_by_pick_number", counts="sample_count_by_pick_number", least=LEAST_PICKS),
    },
    "kingdoms": card_numbers({"AverageCopiesBought": "average_copies_bought", "TurnCountAssociation": "turn_count_delta", "OpeningBuyRate": "opening_buy_rate", "PileExhaustionRate": "pile_exhaustion_rate", "VetoRate": "veto_rate"})
    | {
        "CopiesBoughtDistributionDojo": View("card_class", "CopiesBoughtDistributionMetric", "copies_class", classes=COPIES),
        "WinningDeckMaskedCardDojo": masked_from_deck("WinningDeckMaskedCardMetric"),
        "KingdomGameLengthDojo": View("group_number", "KingdomGameLengthMetric", "winner_turns", groups=(KINGDOM,), cap=MOST_TURNS),
        "NextTurnActionCountDojo": View("group_number", "NextTurnActionCountMetric", "next_turn_action_count", groups=(PARTIAL,), cap=MOST_ACTIONS),
        "FullDeckWinPredictionDojo": View("group_bit", "FullDeckWinPredictionMetric", "won", groups=DECK),
        "KingdomEndingTypeDojo": View("group_class", "KingdomEndingTypeMetric", "ending_type", groups=(KINGDOM,), classes=ENDINGS),
        "DeckPairWinnerDojo": View("group_bit", "DeckPairWinnerMetric", "lo_won", groups=DECK_PAIR, swap=True),
        "MidGameDeckPairWinnerDojo": View("group_bit", "MidGameDeckPairWinnerMetric", "lo_wins", groups=DECK_PAIR, swap=True),
        "EventualWinDojo": View("group_bit", "EventualWinProbabilityMetric", "player_wins", groups=(PARTIAL, KINGDOM)),
        "OpeningBuyOutcomeDojo": View("group_bit", "OpeningBuyOutcomeMetric", "won", groups=(Group("deck", "opening_group_uuid"), KINGDOM)),
        "WinningDeckMembershipDojo": View("group_bit", "WinningDeckMembershipMetric", "in_winning_deck", groups=CARD_IN_KINGDOM, split_by="kingdom_uuid"),
        "KingdomEndingPileDojo": View("group_bit", "KingdomEndingPilePredictionMetric", "exhausted", groups=CARD_IN_KINGDOM, split_by="kingdom_uuid"),
        "WinningDeckCountDojo": View("group_number", "WinningDeckCountMetric", "winning_deck_count", groups=CARD_IN_KINGDOM, split_by="kingdom_uuid"),
        "DeckCardSetCopyCountDojo": View("group_number", "DeckCardSetCopyCountMetric", "count", groups=(Group("card", "card_uuid"), Group("deck", "deck_set_uuid")), split_by="deck_set_uuid"),
        "KingdomOpeningBuyDojo": View("options", "KingdomOpeningBuyPredictionMetric", "opening_card_uuids", groups=(SUPPLY,)),
        "KingdomVetoDojo": View("options", "KingdomVetoPredictionMetric", "vetoed_card_uuids", groups=(Group("deck", "candidate_pool_uuid", distinct=True),)),
        "NextBuyDojo": View("options", "NextBuyPredictionMetric", "next_buy_card_uuids", groups=(SUPPLY, PARTIAL)),
        "NextTrashedCardDojo": View("options", "NextTrashedCardMetric", "next_trashed_card_uuids", groups=(Group("deck", "partial_deck_uuid", distinct=True), PARTIAL)),
    },
}
