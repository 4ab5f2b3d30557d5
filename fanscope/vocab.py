"""Default vocabularies and the default census dimension.

Callers may pass their own; these are the defaults a user of the original job
gets, so they are stated verbatim.
"""

from __future__ import annotations

# --- Fixed values (must equal the original job's lists for equal results) ---

# Entity types per category group. Groups overlap on purpose, so membership is
# many-to-many: a slice is taken per group.
CATEGORY_PEOPLE = [
    "Actor/director", "Artist", "Athlete", "Author", "Blogger", "Business person",
    "Chef", "Coach", "Dancer", "Designer", "Doctor", "Entertainer", "Entrepreneur",
    "Government official", "Journalist", "Lawyer", "Literary editor", "Monarch",
    "Musician/band", "News personality", "Personal blog", "Personal website",
    "Photographer", "Politician", "Producer", "Public figure", "Publisher",
    "Teacher", "Writer",
]

CATEGORY_MUSIC = [
    "Album", "Arts/entertainment/nightlife", "Concert tour", "Concert venue",
    "Music", "Music award", "Music chart", "Music video", "Musical genre",
    "Musical instrument", "Musician/band", "Radio station", "Record label", "Song",
]

CATEGORY_NEW_MEDIA = [
    "App", "App page", "Blogger", "Business/economy website",
    "Computers/internet website", "Education website", "Entertainment website",
    "Government website", "Health/wellness website", "Home/garden website",
    "Internet/software", "News/media website", "Personal blog", "Personal website",
    "Recreation/sports website", "Reference website", "Regional website",
    "Science website", "Society/culture website", "Teens/kids website",
    "Video game", "Website",
]

CATEGORY_OLD_MEDIA = [
    "Article", "Author", "Book", "Book genre", "Book series", "Book store",
    "Entertainer", "Journalist", "Magazine", "Media/news/publishing", "Movie",
    "Movie character", "Movie general", "Movie genre", "Movie theater",
    "Museum/art gallery", "News personality", "Newspaper", "One-time tv program",
    "Performance art", "Photographer", "Publisher", "Radio station",
    "Record label", "Tv", "Tv channel", "Tv genre", "Tv network", "Tv season",
    "Tv show", "Tv/movie award",
]

# Entity names for the name slice; matched case-insensitively.
SLICE_NAMES = [
    "Salman Khan", "Amitabh Bachchan", "Shah Rukh Khan", "Mahendra Singh Dhoni",
    "Akshay Kumar", "Virat Kohli", "Aamir Khan", "Deepika Padukone",
    "Hrithik Roshan", "Sachin Tendulkar", "Ranbir Kapoor", "Priyanka Chopra",
    "AR Rahman", "Priety Zinta", "Saif Ali Khan", "Yo Yo Honey Singh",
    "Sonakshi Sinha", "Virender Sehwag", "Shikhar Dhawan", "Gautam Gambhir",
    "Katrina Kaif", "Kareena Kapoor Khan", "Karan Johar", "Madhuri Dixit",
    "Ajay Devgn", "Ravindra Jadeja", "Sonu Nigam", "Shreya Ghoshal",
    "Suresh Raina", "Mahesh Bab", "Sonam Kapoor", "Shahid Kapoor", "Kapil Sharma",
    "Arijit Singh", "Yuvraj Singh", "Farhan Akhtar", "Ranveer Singh",
    "Ajinkya Rahane", "A. R. Murugadoss", "Mika Singh", "Vijay", "Anushka Sharma",
    "John Abraham", "Sunny Leone", "Rajinikanth", "Bhuvneshwar Kumar",
    "Harbhajan Singh", "Ishant Sharma", "Saina Nehwal", "Rohit Sharma",
    "Ajith Kumar", "Abhishek Bachchan", "Alia Bhatt", "Parineeti Chopra",
    "Sania Mirza", "Sunidhi Chauhan", "MC Mary Kom", "Chetan Bhagat",
    "Sanjay Leela Bhansali", "Aishwarya Rai Bachchan", "Vidya Balan",
    "Jacqueline Fernandez", "Arjun Kapoor", "Kangana Ranaut", "Varun Dhawan",
    "Shraddha Kapoor", "Bipasha Bas", "Riteish Deshmukh", "Anupam Kher",
    "Rohit Shetty", "Navjot Singh Sidh", "Nargis Fakhri", "Anurag Kashyap",
    "Pawan Kalyan", "Shilpa Shetty", "Imtiaz Ali", "Anil Kapoor", "Dhanush",
    "Kirron Kher", "Allu Arjun", "Sukhwinder Singh", "Shankar-Ehsaan-Loy",
    "Hema Malini", "Viswanathan Anand", "Vishal-Shekhar", "Shaan", "Leander Paes",
    "Prabhudheva", "Rohan Bopanna", "Sajid Nadiadwala", "Anirban Lahiri",
    "Mithun Chakraborty", "Vir Das", "Manish Paul", "Malaika Arora Khan",
    "Amish Tripathi", "Ram Kapoor", "Remo D’Souza", "Remo D'Souza",
    "Terence Lewis", "Papa CJ",
]

# Literate population by single year of age, ages 0..100 (index = age; the
# last entry is 100 and over), from the 2011 census of India.
CENSUS_LITERATE_POPULATION_BY_AGE = [
    0, 0, 0, 0, 0, 0, 0, 18078426, 22836959, 20932734, 27097602, 22752473,
    25485778, 22470207, 23157384, 23299497, 22079806, 19179012, 24230172,
    18280414, 23909575, 17182886, 19451235, 15909972, 16291062, 21157909,
    16002881, 13477556, 16609586, 11531593, 21149737, 10647483, 12807680,
    9415375, 10245116, 18388103, 11040369, 8401340, 11394227, 8053518, 16604355,
    7822152, 8726307, 6188597, 6289829, 13149218, 6937791, 5289238, 6920672,
    4943645, 10813513, 4877775, 4855189, 3648744, 4051825, 7690633, 4203895,
    2938623, 3743110, 2887713, 7125485, 3081459, 2991548, 2303571, 2172205,
    4955651, 2168383, 1462463, 1717746, 1321133, 3593624, 1344096, 1132446,
    771701, 798351, 1696250, 770476, 472750, 529080, 402755, 1090392, 403511,
    309685, 220316, 223459, 445274, 209078, 127272, 127775, 98608, 242506,
    113850, 89818, 59419, 62942, 108739, 63190, 43766, 55285, 24566, 279107,
]

# --- End of fixed values ---

CATEGORY_GROUPS = {
    "people": CATEGORY_PEOPLE,
    "music": CATEGORY_MUSIC,
    "new_media": CATEGORY_NEW_MEDIA,
    "old_media": CATEGORY_OLD_MEDIA,
}
